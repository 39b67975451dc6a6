"""Surrogates for personal data: keyed, of the same type and form, distinct, the same everywhere.

Entities are found by form (addresses, numbers) or by title and given name (persons). Every distinct
entity of the corpus gets one surrogate, drawn by a keyed hash from values of its type, script,
gender and form. Surrogates of one kind that meet, or that are themselves an entity of the corpus,
are drawn again until all are distinct and new, so that equal entities stay equal and different
ones different after replacement. Only distinct entities are exchanged, never texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from softseek.llm import words as W
from softseek.session import materialize

# Given names by script and gender, endings of family names by script.
GIVEN = {
    ("latin", "f"): "Anna Clara Diana Elena Emma Helen Ida Irene Julia Laura Lena Linda Lucia Maria Martha Nora Paula Rosa Sarah Teresa".split(),
    ("latin", "m"): "Adam Albert Carl Daniel David Erik Felix Henry Hugo James John Leo Lukas Mark Martin Oscar Paul Peter Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Раиса Софья Тамара Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Никита Олег Павел Роман Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Ζωή Θεοδώρα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Μάριος Νίκος Πέτρος Σπύρος Φώτης".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо ва ве го да де до за ка ко ла ле ма ме мо на но па по ра ро са се со та те то".split(),
    "greek": "βα βε γα γο δα δε κα κο λα λε μα μο να νο πα πο ρα ρο σα σε τα το".split(),
}
ENDINGS = {"latin": "ler man son ner ton rick".split(), "cyrillic": "нов кин ский ченко".split(), "greek": "κης δης πουλος".split()}
# Titles before a name, by gender; x: either.
TITLES = {"m": "Mr Herr Monsieur Señor Sr Don господин κύριος".split(), "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña госпожа κυρία".split(),
          "x": "Dr Prof".split()}
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_GIVEN_GENDER = {n: g for (_, g), names in GIVEN.items() for n in names}
# A run of capitalised words; which of them are names is decided by what stands before and in it.
_NAMED = re.compile(
    r"(?<!\w)(?:(?P<title>" + "|".join(_TITLE_GENDER) + r")\.?[  ]|(?=(?:" + "|".join(_GIVEN_GENDER) + r")(?!\w)))"
    r"(?P<names>[^\W\d_a-z][^\W\d_]{1,30}(?:[  -][^\W\d_a-z][^\W\d_]{1,30}){0,2})(?!\w)"
)
_NAME_KEYS = ahocorasick.Automaton()
for _word in (*_TITLE_GENDER, *_GIVEN_GENDER):
    _NAME_KEYS.add_word(_word, True)
_NAME_KEYS.make_automaton()
_DIGITS = re.compile(
    r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.]?\d))|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<!\w)\+\d[\d ().-]{6,18}\d(?!\d))|(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?![ -]?\d))"
    # National numbers: area code in brackets, trunk zero, pairs of digits, three groups with the same mark.
    r"|(?P<national>(?:(?<!\w)\(\d{2,5}\)[ ./-]?\d{2,8}(?:[ .-]\d{2,5}){0,3}|(?<![\w.-])0[1-9]\d{1,4}[ /-]\d{3,8}(?:[ -]\d{2,5}){0,2}"
    r"|(?<![\w.-])0[1-9](?:[ .-]\d\d){4}|(?<![\w.-])(?:1[.-])?[2-9]\d\d(?P<mark>[.-])[2-9]\d\d(?P=mark)\d{4})(?!\w|[.-]\d))",
    re.ASCII,
)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", re.ASCII)
_LOCAL, _DOMAIN = re.compile(r"[\w.%+-]"), re.compile(r"[\w-]+(?:\.[\w-]+)+")


def script(word: str) -> str:
    for c in word:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
    return "latin"


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        while start < at and text[start] in ".-%+":
            start += 1
        match = _DOMAIN.match(text, at + 1)
        if start < at and match:
            end = match.end()
            while text[end - 1] in "-_":
                end -= 1
            free = end
            yield "email", start, end
        at = text.find("@", max(at + 1, free))


def _names(text: str) -> Iterator[tuple[str, int, int]]:
    if next(_NAME_KEYS.iter(text), None) is None:
        return
    for match in _NAMED.finditer(text):
        words = [(m.start() + match.start("names"), m.group()) for m in re.finditer(r"[^  -]+", match["names"])]
        gender = _TITLE_GENDER.get(match["title"] or "", None)
        if len(words) > 1 or words[0][1] in _GIVEN_GENDER:
            given = words[:-1] if len(words) > 1 else words
            for at, word in given:
                g = _GIVEN_GENDER.get(word) or (gender if gender in ("m", "f") else "x")
                yield f"given_{g}", at, at + len(word)
            words = words[len(given) :]
        for at, word in words:
            yield "family", at, at + len(word)


def _iban_right(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _number_right(match: re.Match) -> bool:
    if match["ip"]:
        return all(int(x) < 256 for x in match["ip"].split("."))
    return not match["national"] or sum(c.isdigit() for c in match["national"]) >= 9


def find_entities(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, in order, not overlapping; of two that meet the first."""
    found = list(_emails(text))
    found += [("phone" if m["national"] else m.lastgroup, *m.span()) for m in _DIGITS.finditer(text) if _number_right(m)]
    found += [("iban", *m.span()) for m in _IBAN.finditer(text) if _iban_right(m.group())]
    found += list(_names(text))
    out, end = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= end:
            out.append((kind, a, b))
            end = b
    return out


def canonical(kind: str, value: str) -> str:
    """Spellings of one entity: numbers without separators, addresses in lower case."""
    if kind in ("card", "phone", "ssn", "iban"):
        return re.sub(r"[^0-9A-Za-z+]", "", value)
    return value.lower() if kind == "email" else value


class _Draw:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *what: object):
        self.seed = hashlib.blake2b(repr(what).encode(), key=key, digest_size=32).digest()
        self.pool, self.n = b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.blake2b(self.seed + self.n.to_bytes(8, "little"), digest_size=64).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:8], "little"), self.pool[8:]
        return value % n

    def like(self, text: str) -> str:
        """Letters for letters of the same case, digits for digits; the rest stays."""
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                letter = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}.get(script(c), "abcdefghijklmnopqrstuvwxyz")
                pick = letter[self.below(len(letter))]
                out.append(pick.upper() if c.isupper() else pick)
            else:
                out.append(c)
        return "".join(out)


def _luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def surrogate(kind: str, value: str, key: bytes, attempt: int) -> str:
    """A value of the kind in canonical form for a canonical entity; later attempts widen the choice."""
    draw = _Draw(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        site = _Draw(key, "domain", domain, 0)  # one domain stays one domain
        return f"{draw.like(local)}{draw.below(10 ** (attempt // 8)) if attempt >= 8 else ''}@{site.like(host)}.{top}"
    if kind == "ip":
        parts = value.split(".")
        kept = 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] or parts[0] == "172" and 16 <= int(parts[1]) < 32 else 0
        if kept and attempt >= 8:  # the range is used up: another private one, at last any
            parts, kept = ["10"], int(attempt < 24)
        first = [str(1 + draw.below(223))] if not kept else []
        return ".".join(parts[:kept] + first + [str(draw.below(254) + 1) for _ in range(4 - kept - len(first))])
    if kind == "card":
        body = value[0] + draw.like(value[1:-1])
        return body + (_luhn_digit(body) if _luhn_digit(value[:-1]) == value[-1] else draw.like("0"))
    if kind == "phone":
        kept = 3 if attempt < 8 else 1
        return value[:kept] + draw.like(value[kept:])
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "iban":
        body = draw.like(value[4:])
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    letters = script(value)
    if kind.startswith("given"):
        gender = kind[-1] if kind[-1] in "mf" else "mf"[draw.below(2)]
        names = GIVEN[letters, gender]
        made = names[draw.below(len(names))]
        for _ in range(attempt // 4):  # the list is used up: names made of a name and syllables
            made += SYLLABLES[letters][draw.below(len(SYLLABLES[letters]))]
        return made.upper() if value.isupper() else made
    parts = [SYLLABLES[letters][draw.below(len(SYLLABLES[letters]))] for _ in range(2 + attempt // 4)]
    made = ("".join(parts) + ENDINGS[letters][draw.below(len(ENDINGS[letters]))]).capitalize()
    return made.upper() if value.isupper() else made


def shaped(original: str, made: str, kind: str) -> str:
    """The canonical surrogate with the separators of the original spelling."""
    if kind == "email":
        return made.upper() if original.isupper() else made
    if kind not in ("card", "phone", "ssn", "iban"):
        return made
    rest = iter(made)
    return "".join(next(rest) if c.isalnum() or c == "+" else c for c in original)


def _entity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in W.chunks(batches, "text", 4 << 20):
        rows = [
            (doc_id, kind, value)
            for doc_id, text in zip(chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist(), strict=True)
            if text
            for kind, value in sorted({(k, canonical(k, text[a:b])) for k, a, b in find_entities(text)})
        ]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        types = [pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "kind", "value"])


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("kind", "value", "attempt")]
            made = [surrogate(k, v, key, n) for k, v, n in zip(*(c.to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.string())], names=["kind", "value", "attempt", "made"])

    return run


def assign(entities: DataFrame, key: bytes, rounds: int = 200) -> DataFrame:
    """``kind, value, made``: a surrogate for each distinct ``(kind, value)``, distinct and no entity."""
    schema = "kind string, value string, attempt int, made string"
    distinct = materialize(entities.select("kind", "value").distinct(), "entities")
    group = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    taken = distinct.select(group.alias("group"), F.col("value").alias("made"), F.lit("").alias("holder"))
    settled = None
    open_ = distinct.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        drawn = materialize(open_.mapInArrow(_drawn(key), schema).withColumn("group", group), "drawn")
        first = drawn.groupBy("group", "made").agg(F.min(F.concat("kind", F.lit(":"), "value")).alias("holder"))
        free = first.join(taken.select("group", "made"), ["group", "made"], "left_anti")
        won = drawn.join(free, ["group", "made"]).where(F.concat("kind", F.lit(":"), "value") == F.col("holder"))
        won = materialize(won.select("kind", "value", "group", "made"), "won")
        settled = won if settled is None else settled.unionByName(won)
        open_ = drawn.join(won.select("kind", "value"), ["kind", "value"], "left_anti")
        open_ = materialize(open_.select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "open")
        if not open_.head(1):
            return settled.select("kind", "value", "made")
        taken = taken.unionByName(won.select("group", "made", F.lit("").alias("holder")))
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def replace_entities(docs: DataFrame, key: bytes, text: str = "text", broadcast_rows: int = 200_000, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``docs(doc_id, text, ...)`` with surrogates in ``text`` and ``entities
    array<struct<kind,start,end>>`` (places in the new text).

    One key gives one mapping; equal entities get equal surrogates in all documents, different
    entities of a kind different ones, and no surrogate is an entity of the corpus. Null text stays
    null. Rows may share a doc_id. A column ``entities`` of ``docs`` is replaced. ``broadcast_rows``,
    ``broadcast_bytes``: mappings of up to so many documents and measured bytes are broadcast, more
    are joined by doc_id; the result is the same.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = materialize(narrow.mapInArrow(_entity_rows, "doc_id long, kind string, value string").distinct(), "held")
    made = assign(held, key)
    pair = F.struct("kind", "value", "made")
    maps = held.join(made, ["kind", "value"]).groupBy("doc_id").agg(F.collect_list(pair).alias("_made"))
    maps = materialize(maps.withColumnRenamed("doc_id", "_doc"), "maps")
    # A row holds all entities of a document, so rows alone bound nothing.
    size = "aggregate(_made, 64L, (n, e) -> n + 64 + octet_length(e.kind) + octet_length(e.value) + octet_length(e.made))"
    measured = maps.selectExpr("count(*) as n", f"coalesce(sum({size}), 0) as bytes").first()
    if measured["n"] <= broadcast_rows and measured["bytes"] <= broadcast_bytes:
        maps = F.broadcast(maps)
    kept = docs.drop("entities")
    joined = kept.join(maps, kept["doc_id"].cast("long").eqNullSafe(maps["_doc"]), "left").drop("_doc")
    fields = "entities array<struct<kind: string, start: long, end: long>>"
    schema = StructType(kept.schema.fields + StructType.fromDDL(fields).fields)
    names = kept.columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches, text, 4 << 20):
            texts, places = [], []
            for value, mapped in zip(chunk.column(text).to_pylist(), chunk.column("_made").to_pylist(), strict=True):
                new, spans = _replaced(value, {(m["kind"], m["value"]): m["made"] for m in mapped or ()})
                texts.append(new)
                places.append(spans)
            columns = {name: chunk.column(name) for name in names}
            columns[text] = pa.array(texts, chunk.column(text).type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(places, kind)], names=schema.names)

    return joined.mapInArrow(run, schema)


def _replaced(text: str | None, made: dict[tuple[str, str], str]) -> tuple[str | None, list[dict]]:
    if not text or not made:
        return text, []
    out, spans, at, length = [], [], 0, 0
    for kind, a, b in find_entities(text):
        new = shaped(text[a:b], made[kind, canonical(kind, text[a:b])], kind)
        out += [text[at:a], new]
        length += a - at
        spans.append({"kind": kind, "start": length, "end": length + len(new)})
        length += len(new)
        at = b
    out.append(text[at:])
    return "".join(out), spans
