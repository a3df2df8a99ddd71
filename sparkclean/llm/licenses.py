"""Licence scan by sentences: known sentences become identifiers, and ordered rules match identifier sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences in normal form, by identifier: fixed values.
SENTENCES = {
    "a01": "licensed under the apache license version 2 0",
    "a02": "licensed under the apache license version 2 0 the license",
    "a03": "you may not use this file except in compliance with the license",
    "a04": "you may obtain a copy of the license at",
    "a05": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "a06": "see the license for the specific language governing permissions and limitations under the license",
    "a07": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "b01": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "b02": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "b03": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "b04": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "c01": "licensed under cc by nc 4 0",
    "c02": "licensed under cc by 4 0",
    "c03": "licensed under cc by sa 4 0",
    "c04": "this work is licensed under a creative commons attribution 4 0 international license",
    "c05": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "c06": "licensed under cc0 1 0",
    "e01": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "g01": "this work is licensed under the gnu general public license version 3",
    "g02": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "g03": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "g04": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "g05": "see the gnu general public license for more details",
    "i01": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "l01": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "l02": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "l03": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "m01": "released under the mit license",
    "m02": "licensed under the mit license",
    "m03": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "m04": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "m05": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "p01": "this source code form is subject to the terms of the mozilla public license v",
    "p02": "2 0",
    "r01": "all rights reserved",
    "u01": "this is free and unencumbered software released into the public domain",
    "z01": "this software is provided as is without any express or implied warranty",
    "z02": "in no event will the authors be held liable for any damages arising from the use of this software",
    "z03": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}
#: Licence rules in order of precedence: a name and its identifier sequence. At each place the first rule that fits is taken: fixed values.
RULES = [
    ("Apache-2.0", "a02 a03 a04 a05 a06"),
    ("Apache-2.0", "a02 a03 a05 a06"),
    ("Apache-2.0", "a02 a03"),
    ("Apache-2.0", "a07 a04 a05 a06"),
    ("Apache-2.0", "a07"),
    ("Apache-2.0", "a02"),
    ("Apache-2.0", "a01"),
    ("BSD-3-Clause", "b01 b02 b03 b04"),
    ("BSD-2-Clause", "b01 b02 b03"),
    ("GPL-3.0-or-later", "g02 g04 g05"),
    ("GPL-3.0-or-later", "g02 g04"),
    ("GPL-3.0-or-later", "g02"),
    ("GPL-2.0-or-later", "g03 g04 g05"),
    ("GPL-2.0-or-later", "g03 g04"),
    ("GPL-2.0-or-later", "g03"),
    ("GPL-3.0-only", "g01"),
    ("MIT", "m03 m04 m05"),
    ("MIT", "m03 m04"),
    ("MIT", "m01"),
    ("MIT", "m02"),
    ("CC-BY-NC-4.0", "c01"),
    ("CC-BY-4.0", "c02"),
    ("CC-BY-4.0", "c04"),
    ("CC-BY-SA-4.0", "c03"),
    ("CC-BY-SA-4.0", "c05"),
    ("CC0-1.0", "c06"),
    ("EPL-2.0", "e01"),
    ("ISC", "i01"),
    ("LGPL-2.1-or-later", "l01"),
    ("LGPL-3.0-or-later", "l02"),
    ("AGPL-3.0-or-later", "l03"),
    ("MPL-2.0", "p01 p02"),
    ("Unlicense", "u01"),
    ("zlib", "z01 z02 z03"),
    ("all-rights-reserved", "r01"),
]
#: A sentence ends at such a mark after a letter, digit, quote or bracket and before a blank, or at a line's end.
END = r"""([A-Za-z0-9"')][.!?])[ \t]+"""
#: But a line of 41 to 100 characters without such a mark is wrapped and goes on in the next one. Lines stand between
#: these two characters meanwhile.
BEGIN, STOP = "\x02", "\x03"
WRAPPED = r"\x02([^\x02\x03]{40,99}[^.!?:;\x02\x03\r \t])[ \t\r]*\x03"
#: What stands for an unknown sentence in a sequence of identifiers, and how many of them a rule passes over between two of its own.
GAP, GAPS = "---", 2


def _pattern(rules: list[tuple[str, str]]) -> str:
    return "|".join(f" (?:{GAP} ){{0,{GAPS}}}".join(ids.split()) + " " for _, ids in rules)


def sentences(text: Column) -> Column:
    """The sentences of a text in normal form: lower case, other characters than a-z and 0-9 as one blank."""
    lined = F.concat(F.lit(BEGIN), F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(STOP + BEGIN)), F.lit(STOP))
    whole = F.regexp_replace(lined, WRAPPED, f"{BEGIN}$1 ")
    parts = F.split(F.regexp_replace(whole, END, f"$1{STOP}"), STOP)
    normal = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(normal, lambda s: s != "")


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """For every row of ``docs`` (``doc_id``, ``text``): ``(doc_id, n_sentences, sentence_ids, licenses, n_matches)``.

    ``sentence_ids`` are the identifiers of the known sentences in text order, ``licenses`` the rules that match
    them, left to right without overlap, joined by commas in text order with repeats; unknown sentences part a rule's
    own, but for ``GAPS`` of them, as a web address or a line on the author. A null or empty text has no
    sentences and empty strings. Identifiers are of one length. Repeated rows and null ids come out as they are;
    other columns are ignored.
    """
    by_sentence = F.create_map(*[F.lit(x) for name, text in known.items() for x in (text, name)])
    by_rule = F.create_map(*[F.lit(x) for ids, name in {ids: name for name, ids in reversed(rules)}.items() for x in (f"{ids} ", name)])
    rows = docs.select("doc_id", sentences(F.col("text")).alias("s"))
    rows = rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.transform("s", lambda s: F.when(s.isin(list(known.values())), F.try_element_at(by_sentence, s)).otherwise(GAP)).alias("all"))
    rows = rows.withColumn("ids", F.filter("all", lambda i: i != GAP))
    rows = rows.withColumn("found", F.regexp_extract_all(F.concat(F.array_join("all", " "), F.lit(" ")), F.lit(_pattern(rules)), F.lit(0)))
    rows = rows.withColumn("found", F.transform("found", lambda m: F.replace(m, F.lit(f"{GAP} "), F.lit(""))))
    return rows.select(
        "doc_id", "n_sentences", F.array_join("ids", " ").alias("sentence_ids"),
        F.array_join(F.transform("found", lambda m: F.try_element_at(by_rule, m)), ",").alias("licenses"), F.size("found").cast("long").alias("n_matches"),
    )


def scan_sql(known: dict[str, str] = SENTENCES, rules: list[tuple[str, str]] = RULES) -> str:
    """The same over the view ``documents`` as DuckDB SQL."""
    ids = " ".join(f"WHEN '{text}' THEN '{name}'" for name, text in known.items())
    names = " ".join(f"WHEN '{ids} ' THEN '{name}'" for name, ids in rules)
    values = ", ".join(f"'{text}'" for text in known.values())
    end = END.replace("'", "''")
    return f"""
WITH parts AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(chr(2) || replace(coalesce(text, ''), chr(10), chr(3) || chr(2)) || chr(3), '{WRAPPED}', chr(2) || '\\1 ', 'g'), '{end}', '\\1' || chr(3), 'g'), chr(3)),
    lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS s FROM documents),
ids AS (
  SELECT doc_id, len(s) AS n_sentences, list_transform(s, lambda x: CASE WHEN x IN ({values}) THEN CASE x {ids} END ELSE '{GAP}' END) AS every FROM parts),
found AS (
  SELECT doc_id, n_sentences, list_filter(every, lambda x: x <> '{GAP}') AS ids,
    list_transform(regexp_extract_all(array_to_string(every, ' ') || ' ', '{_pattern(rules)}', 0), lambda m: replace(m, '{GAP} ', '')) AS found FROM ids)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids,
  coalesce(array_to_string(list_transform(found, lambda m: CASE m {names} END), ','), '') AS licenses, CAST(len(found) AS BIGINT) AS n_matches
FROM found"""
