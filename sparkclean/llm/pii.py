"""Personal data becomes keyed surrogates of the same type and format.

Each distinct entity of the table gets one surrogate, so mentions of it stay linked; a check over all entities gives
a new surrogate to whatever met another entity's surrogate or a real entity, until all are distinct.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from typing import TypeVar

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage

T = TypeVar("T")

#: Given names by gender and script, and titles that go before a name: fixed values.
GIVEN = {
    ("f", "latin"): "Alice Amelia Anna Barbara Carmen Caroline Charlotte Claudia Clara Diana Elena Elisabeth Emily Emma Eva Hannah Helen Ingrid Isabel Jane Jennifer Julia Karin Laura Lucia Margaret Maria Marie Martha Mary Monika Olivia Patricia Petra Rachel Rosa Sabine Sarah Sofia Sophie Susan Teresa Ursula Victoria".split(),
    ("m", "latin"): "Adam Albert Alexander Andreas Anthony Carlos Charles Christopher Daniel David Diego Edward Felix Fernando Francisco Frank Frederick George Hans Henry Jacques James Jean Johann John Jorge Joseph Juan Karl Louis Luis Manuel Martin Michael Miguel Nicolas Paul Peter Philippe Richard Robert Stefan Thomas William".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
    ("f", "greek"): "Αικατερίνη Άννα Βασιλική Γεωργία Ελένη Ειρήνη Μαρία Σοφία".split(),
    ("m", "greek"): "Αλέξανδρος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Χρήστος".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Doña Госпожа Κυρία".split(), "m": "Mr Herr Monsieur Señor Don Sir Господин Κύριος".split(), "": "Dr Prof".split()}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ha he ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se so ta te ti to va ve vi".split(),
    "cyrillic": "ба бе ва ве га да де жи за ка ко ла ле ли ло ма ми мо на не ни ра ре ри ро са се та те то ха".split(),
    "greek": "βα γα δε δη κα κο λα λε μα μη νι νο πα πο ρα ρι σα σε τα το".split(),
}
#: Titles whose capitals are also other words, and words in lower case inside a name: fixed values.
_NO_CAPITALS = set("Ms Miss Don Sir Madame".split())
PARTICLES = "af al av bin da das de del della den der di do dos du e el ibn la las le los of ten ter van vom von y zu zum zur".split()
#: What stands before a name of two words or more, whose first word is in no list: fixed values.
CUES = "[Nn]ame is|[Nn]ame|[Cc]ontact|[Ss]igned|[Rr]egards|[Ss]incerely|[Aa]uthor|[Aa]ttn|[Aa]ttention|[Dd]ear|[Ss]igned by|[Ww]ritten by|[Ff]rom|[Cc]c".split("|")
#: Endings of invented given names, by gender and script: fixed values.
ENDINGS = {("f", "latin"): "na ra lia".split(), ("m", "latin"): "no ric ton".split(), ("f", "cyrillic"): "на ра лия".split(), ("m", "cyrillic"): "н р лий".split(), ("f", "greek"): "να ρα λία".split(), ("m", "greek"): "νος ρης λιος".split()}
ALPHABET = {"latin": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "cyrillic": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ", "greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}


def _bare(word: str) -> str:
    """A word without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _with_capitals(words: dict[str, T]) -> dict[str, T]:
    """Also what the words mean in capitals, with accents or without."""
    return {f(w.upper()): x for w, x in words.items() for f in (_bare, str)} | words


_NAMED = _with_capitals({name: name for names in GIVEN.values() for name in names})
_GENDER = {name: (g, script) for (g, script), names in GIVEN.items() for name in names}
_TITLE = {name: g for g, names in TITLES.items() for name in names}
_TITLE = _with_capitals({name: g for name, g in _TITLE.items() if name not in _NO_CAPITALS}) | _TITLE
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_UPPER = "[" + "".join(c for c in map(chr, range(0x2C00)) if c.isupper() and c.isalpha()) + "]"
#: Further words of a name: initials with a dot, or a word with a capital, also after d' or l'; particles before them.
_FURTHER = rf"(?:[ \u00a0]+(?:(?:{'|'.join(PARTICLES)})[ \u00a0]+)*(?:(?:{_UPPER}\.-?)+(?:{_UPPER}{_WORD})?|(?:[dl]['’])?(?={_UPPER}){_WORD}))"
#: What a text must hold to be looked through at all; it must cover every pattern below.
MAYBE = r"@|[0-9][0-9 .()/-]{5,}[0-9]|[0-9A-Fa-f]{32}|AKIA[0-9A-Z]{16}|gh[pousr]_|sk-[A-Za-z0-9]{20}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|\b(?=\p{Lu})(?:" + "|".join([*_TITLE, *_NAMED]) + rf")\b|\b(?:{'|'.join(CUES)})[:,]?[ \u00a0\n]{{1,4}}\p{{Lu}}"
_PATTERNS = {
    # a search for an address begins at the first sign of its local part alone, so a long word is gone through once
    "email": r"(?<![\w.%+'-])[_.%+'-]*+(?P<address>[^\W_][\w.%+'-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\w|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w+])[0-9](?:[ -]?[0-9]){12,18}(?!\w)",
    "phone": r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?!\w)",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?!\w)",
    "person": rf"\b(?:{'|'.join(_TITLE)})\.?(?:[ \u00a0]+(?:{'|'.join(_TITLE)})\b\.?)*{_FURTHER}+|\b(?:{'|'.join(_NAMED)})\b(?:-(?={_UPPER}){_WORD})?{_FURTHER}*",
    "cued": rf"\b(?:{'|'.join(CUES)})[:,]?[ \u00a0\n]{{1,4}}(?P<name>(?={_UPPER}){_WORD}{_FURTHER}+)",
}
_FIND = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in _PATTERNS.items()))


def _luhn(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


def _name(word: str) -> tuple[str, str]:
    """Kind and canonical form of a word of a name."""
    if word in _NAMED:
        g, script = _GENDER[_NAMED[word]]
        return f"given {g} {script}", _NAMED[word]
    script = _script(word)
    return (f"initial {script}", _bare(word).upper()) if len(word) == 1 else (f"surname {script}", word.lower())


def mentions(text: str) -> Iterator[tuple[int, int, str, str]]:
    """``(begin, end, kind, canonical form)`` of each entity, left to right; equal forms are one entity."""
    for m in _FIND.finditer(text):
        kind = next(k for k in _PATTERNS if m[k] is not None)
        inner = {"email": "address", "cued": "name"}.get(kind, kind)
        found, begin = m[inner], m.start(inner)
        digits = re.sub(r"[^0-9]", "", found)
        if kind in ("person", "cued"):
            named = False
            for w in re.finditer(_WORD, found):
                if not named and w[0] in _TITLE or w[0] in PARTICLES:
                    continue
                named = True
                parts = list(re.finditer(r"[^-]+", w[0])) if "-" in w[0] else []
                if not any(p[0] in _NAMED for p in parts):
                    parts = [re.search(r"(?![dl]['’]).+", w[0])]
                for p in parts:
                    at = begin + w.start()
                    yield at + p.start(), at + p.end(), *_name(p[0])
            continue
        if kind == "card" and not _luhn(digits):
            continue
        if kind == "iban":
            found = found.replace(" ", "")
            if not _iban_ok(found):
                continue
        yield begin, m.end(), kind, digits[-10:] if kind == "phone" else digits if kind in ("card", "ssn") else found if kind in ("secret", "iban", "ip") else found.lower()


class _Draw:
    """A stream of keyed choices for one entity and attempt."""

    def __init__(self, key: bytes, *what: str) -> None:
        self.key, self.what, self.pool, self.round = key, "\x1f".join(what).encode("utf-8", "surrogatepass"), 0, 0
        self.left = 1

    def below(self, n: int) -> int:
        if self.left < n << 32:
            self.pool = int.from_bytes(hmac.new(self.key, self.round.to_bytes(4, "big") + self.what, hashlib.sha256).digest(), "big")
            self.left, self.round = 1 << 256, self.round + 1
        self.pool, at = divmod(self.pool, n)
        self.left //= n
        return at

    def like(self, text: str) -> str:
        """Letters and digits of ``text`` by others of the same class, script and case."""
        out = []
        for c in text:
            if c in "0123456789":
                out.append(chr(48 + self.below(10)))
            elif c.isalpha():
                if _script(c) == "latin":
                    new = chr(97 + self.below(26))
                else:
                    new = "абвгдежзиклмнопрстуфхцчшэюя"[self.below(27)] if _script(c) == "cyrillic" else "αβγδεζηθικλμνξοπρστυφχψω"[self.below(24)]
                out.append(new.upper() if c.isupper() else new)
            else:
                out.append(c)
        return "".join(out)


def surrogate(kind: str, form: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity's canonical form: the same kind, length classes, script and gender."""
    draw = _Draw(key, kind, form, str(attempt))
    more = attempt // 4  # who met others again and again gets a longer surrogate
    if kind.startswith("given "):
        _, gender, script = kind.split()
        if attempt < 3:
            order = sorted(GIVEN[gender, script], key=lambda n: hmac.new(key, f"{gender}{n}".encode(), hashlib.sha256).digest())
            return order[(order.index(form) + 1 + attempt) % len(order)]
        syllables, endings = SYLLABLES[script], ENDINGS[gender, script]
        return "".join(syllables[draw.below(len(syllables))] for _ in range(1 + more)).capitalize() + endings[draw.below(len(endings))]
    if kind.startswith("initial "):
        order = sorted(ALPHABET[kind.split()[1]], key=lambda c: hmac.new(key, c.encode(), hashlib.sha256).digest())
        return order[(order.index(form) + 1) % len(order)] if form in order else order[0]
    if kind.startswith("surname "):
        syllables = SYLLABLES[kind.split()[1]]
        return "".join(syllables[draw.below(len(syllables))] for _ in range(min(6, 3 + len(form) // 5) + more))
    if kind == "email":
        local, _, domain = form.partition("@")
        labels = domain.split(".")
        site = _Draw(key, "domain", domain, str(attempt))  # one site stays one site
        return draw.like(local + "x" * more) + "@" + ".".join([*map(site.like, labels[:-1]), labels[-1]])
    if kind == "ip":
        octets = [int(x) for x in form.split(".")]
        if attempt > 8 and octets[0] not in (10, 127):  # a private range of 65,536 or fewer addresses may be full
            octets[0] = 10 if octets[0] in (172, 192) else octets[0]
        fixed = 1 if octets[0] in (10, 127) else 2 if (octets[0], octets[1]) == (192, 168) or octets[0] == 172 and 16 <= octets[1] < 32 else 0
        first = [1 + draw.below(223) for _ in range(8)]
        new = [next((x for x in first if x not in (10, 127, 172, 192)), 11), *(draw.below(256) for _ in range(2)), 1 + draw.below(254)]
        return ".".join(map(str, octets[:fixed] + new[fixed:]))
    if kind == "phone":
        return str(2 + draw.below(8)) + "".join(str(draw.below(10)) for _ in form[1:])
    if kind == "ssn":
        return f"{1 + draw.below(665):03}{1 + draw.below(99):02}{1 + draw.below(9999):04}"
    if kind == "card":
        body = form[0] + "".join(str(draw.below(10)) for _ in form[2:])
        return next(body + str(c) for c in range(10) if _luhn(body + str(c)))
    if kind == "iban":
        body = draw.like(form[4:])
        return next(x for c in range(98) if _iban_ok(x := f"{form[:2]}{c:02}{body}"))
    head = re.match(r"AKIA|gh[pousr]_|sk-|", form)[0]
    if head:
        return head + draw.like(form[len(head) :])
    hexes = "0123456789ABCDEF" if form.upper() == form and re.search("[A-F]", form) else "0123456789abcdef"
    return "".join(hexes[draw.below(16)] for _ in form)


def render(kind: str, mention: str, new: str) -> str:
    """A surrogate written as the mention is: its separators, country prefix and case."""
    if kind in ("phone", "card", "ssn"):
        total, out, k = sum(c in "0123456789" for c in mention), [], 0
        skip = max(0, total - len(new))
        for c in mention:
            if c in "0123456789":
                out.append(new[k - skip] if k >= skip else c)
                k += 1
            else:
                out.append(c)
        return "".join(out)
    if kind == "iban":
        rest = iter(new)
        return "".join(c if c == " " else next(rest) for c in mention)
    if kind.startswith(("given", "initial", "surname")):
        return new.upper() if mention.isupper() and len(mention) > 1 else new[:1].upper() + new[1:]
    if kind == "email" and len(mention) == len(new):
        return "".join(b.upper() if a.isupper() else b for a, b in zip(mention, new))
    return new


def settle(entities: DataFrame, key: bytes, rounds: int = 200) -> DataFrame:
    """``(kind, form, new)`` for distinct ``(kind, form)``: surrogates that differ from each other and from every form.

    Of entities that drew one surrogate the smallest form keeps it; the others draw again, longer ones in time, so that
    a crowded kind finds room. Kinds of a fixed length that are nearly full of real entities end in an error after
    ``rounds`` draws. Given names are tried from a list first, then invented. Initials come from one keyed cycle of the
    alphabet and need no check.
    """

    def drawn(rows: DataFrame, attempt: int) -> DataFrame:
        @F.pandas_udf("string")
        def draw(kind: pd.Series, form: pd.Series) -> pd.Series:
            return pd.Series([surrogate(k, f, key, attempt) for k, f in zip(kind, form)], dtype=object)

        return rows.withColumn("new", draw("kind", "form"))

    entities = stage(entities.select("kind", "form").distinct(), "entities")
    closed = F.col("kind").startswith("initial ")
    done = drawn(entities.where(closed), 0)
    pending = entities.where(~closed)
    # names of both genders and surnames share one set of letters, so they are held apart together
    space = lambda c: F.when(F.col(c).rlike("^(given|surname) "), F.lit("name")).otherwise(F.col(c))
    letters = lambda c: F.when(space("kind") == "name", F.lower(c)).otherwise(F.col(c))
    taken = pending.select(space("kind").alias("space"), letters("form").alias("letters"))
    for attempt in range(rounds):
        tried = stage(drawn(pending, attempt).withColumns({"space": space("kind"), "letters": letters("new")}), "tried")
        first = tried.groupBy("space", "letters").agg(F.min(F.struct("form", "kind", "new")).alias("first")).join(taken, ["space", "letters"], "left_anti")
        won = stage(first.select("space", "letters", "first.*"), "won")
        done, taken = done.unionByName(won.select("kind", "form", "new")), taken.unionByName(won.select("space", "letters"))
        pending = stage(tried.join(won, ["kind", "form"], "left_anti").select("kind", "form"), "pending")
        if pending.isEmpty():
            return done
    raise RuntimeError(f"surrogates still met after {rounds} draws")


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with the entities in column ``text`` replaced, and ``n_entities`` (replaced if it is there already).

    Emails, phone numbers, IP addresses, cards, bank accounts, social security numbers, access keys and names of
    persons get surrogates keyed by ``key``, the same one wherever the entity is mentioned. A null text stays null with
    no entities; texts without entities, extra columns, repeated rows and null ids are passed on as they are.
    """
    if not key:
        raise ValueError("a key is needed")
    docs = docs.drop("n_entities")
    names, quoted = docs.columns, [f"`{c.replace('`', '``')}`" for c in docs.columns]
    own = quoted[names.index(text)]
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(quoted, docs.schema))
    maybe = F.coalesce(F.col(own).rlike(MAYBE), F.lit(False))
    rows = stage(docs.where(maybe).select(F.struct(*quoted).alias("doc")).withColumn("row", F.monotonically_increasing_id()), "maybe")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, *x) for r, t in zip(batch.column("row").to_pylist(), batch.column("t").to_pylist()) for x in sorted({m[2:] for m in mentions(t)})]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))], ["row", "kind", "form"])

    found = stage(rows.select("row", F.col(f"doc.{own}").alias("t")).mapInArrow(seek, "row long, kind string, form string"), "found")
    known = settle(found, key)
    by_row = found.join(known, ["kind", "form"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "form"), "new"))).alias("news"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            texts, counts = [], []
            doc = batch.column("doc").flatten()
            for t, news in zip(doc[at].to_pylist(), batch.column("news").to_pylist()):
                news = dict(news or [])
                out, last, n = [], 0, 0
                for begin, end, kind, form in mentions(t) if news else ():
                    out += [t[last:begin], render(kind, t[begin:end], news[f"{kind}\x1f{form}"])]
                    last, n = end, n + 1
                texts.append("".join([*out, t[last:]]))
                counts.append(n)
            columns = [pa.array(texts, pa.string()) if k == at else column for k, column in enumerate(doc)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*names, "n_entities"])

    changed = rows.join(by_row, "row", "left").select("doc", "news").mapInArrow(apply, f"{schema}, n_entities long")
    return docs.where(~maybe).withColumn("n_entities", F.lit(0).cast("long")).unionByName(changed)
