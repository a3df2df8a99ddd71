"""Names of more than two words, and in capitals."""

import re
import time

import pytest
from pyspark.sql import functions as F

from sparkclean.llm import pii


@pytest.mark.parametrize("name", [
    "Dr. Anna Maria Schmidt", "Mary Ann Evans", "John F. Kennedy", "Prof. Dr. J.R.R. Tolkien", "MARY SMITH", "DR. ANNA SCHMIDT", "Karl von der Weide", "Mrs van Houten",
    "Anna-Maria Schmidt", "Jeanne Marie d'Arlac", "Maria de la Cruz Ortega", "Señor García Márquez", "Иван Петрович Сидоров", "ИВАН СИДОРОВ", "ΑΝΝΑ Παππά", "Mr. O'Brien-Smith",
])
def test_no_word_of_a_name_stays(name):
    text = f"so we met {name}, who left"
    found = list(pii.mentions(text))
    left = text
    for begin, end, *_ in reversed(found):
        left = left[:begin] + left[end:]
    words = [w for w in re.findall(r"[^\W\d_]+", left.replace("so we met", "").replace("who left", ""))]
    assert found and all(w in pii._TITLE or w in pii.PARTICLES or w in ("d", "Jeanne") for w in words), left


def test_words_after_a_name_stay():
    text = "Mary Smith went to Mr and Mrs Brown. Then JOHN left with Anna; Paris was far."
    assert [text[a:b] for a, b, *_ in pii.mentions(text)] == ["Mary", "Smith", "Brown", "JOHN", "Anna"]


def test_rewritten_names(spark):
    texts = ["Dr. Anna Maria Schmidt and John F. Kennedy", "MARY SCHMIDT, É. is no name, Mary É. Ø. Schmidt"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = (r.text for r in pii.pseudonymize(df, b"k").orderBy("doc_id").collect())
    assert not re.search("Anna|Maria|Schmidt|Kennedy|John|F\\.|Mary|MARY", one + two, re.I)
    a, b = re.fullmatch(r"Dr\. \w+ \w+ (\w+) and \w+ [A-Z]\. \w+", one), re.fullmatch(r"[A-Z]+ ([A-Z]+), É\. is no name, \w+ [A-Z]\. [A-Z]\. (\w+)", two)
    assert a[1] == b[2] and a[1].upper() == b[1]


@pytest.mark.parametrize("text", ["ИВАН СИДОРОВ", "вот Иван Петрович Сидоров", "ΑΝΝΑ Παππά", "MARY SMITH", "PROF. SCHMIDT"])
def test_names_alone_are_looked_for(spark, text):
    assert pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"k").first().n_entities > 0


@pytest.mark.parametrize("sign", ["a", "a.", "é", "1", "a-", "_", "+", "(", "A", "Anna ", "de ", "Anna de ", "a@", "@", "1 ", "1.1.", "Name: ", " "])
def test_long_texts_are_gone_through_once(sign):
    began = time.perf_counter()
    list(pii.mentions("x" + sign * (300_000 // len(sign))))
    assert time.perf_counter() - began < 5
    assert [m[3] for m in pii.mentions("b" * 400_000 + " me@mail.example.com")] == ["me@mail.example.com"]


@pytest.mark.parametrize("text, found", [("--jane@x.io", "jane@x.io"), ("_a.b@x.io_", "a.b@x.io"), ("a@b@c.de", "b@c.de"), ("<a+b@c.de>", "a+b@c.de"), ("@x.io", None)])
def test_addresses(text, found):
    assert next((text[a:b] for a, b, kind, _ in pii.mentions(text) if kind == "email"), None) == found


@pytest.mark.parametrize("text", ["Contact Zoe Quill today", "my name is Zoe Quill", "Name: Zoe Quill", "Regards,\nZoe Quill"])
def test_cues_of_unlisted_names(spark, text):
    got = pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"k").first()
    assert got.n_entities == 2 and "Zoe" not in got.text and "Quill" not in got.text


def test_given_names_do_not_become_real_ones(spark):
    """All listed names occur: none of them may stand for another."""
    names = sorted({n for group in pii.GIVEN.values() for n in group})
    df = spark.createDataFrame([(k, f"so {n} Xu came") for k, n in enumerate(names)], "doc_id long, text string")
    new = [r.text.split()[1] for r in pii.pseudonymize(df, b"k").orderBy("doc_id").collect()]
    assert len(set(new)) == len(names) and not set(new) & set(names)


def test_clashing_and_dotted_columns(spark):
    df = spark.createDataFrame([(1, "Mary Smith", "a"), (2, None, "b")], "doc_id long, text string, _news string").withColumns({"a.b": F.lit(1), "doc": F.lit("d"), "news": F.lit("n"), "row": F.lit("r")})
    got = pii.pseudonymize(df, b"k")
    assert got.columns == [*df.columns, "n_entities"] and sorted((r["_news"], r["a.b"], r["doc"], r["n_entities"]) for r in got.collect()) == [("a", 1, "d", 2), ("b", 1, "d", 0)]


def test_crowded_addresses_get_longer(spark):
    """All one-letter addresses of a site, and a site like it: no surrogate of one letter is free."""
    forms = [("email", f"{a}@{b}.io") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    new = [r.new for r in pii.settle(spark.createDataFrame(forms, "kind string, form string"), b"key").collect()]
    assert len(set(new)) == len(forms) == len(new) and not set(new) & {f for _, f in forms}
