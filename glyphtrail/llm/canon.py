"""Bring text that looks the same to one consistent form.

A vocabulary (the lines a collection is known to contain) is kept in a trie whose edges
are classes of look-alike characters, with the canonical spelling at the end node. A text
is read through it by a weighted edit automaton, character by character: an invisible
character is passed over at no cost, another width, composition, ligature, kind of space
or a look-alike letter of another script follows the edge of its class at no cost, and a
visible edit costs its weight (``WEIGHTS``). The live states of the automaton are the
trie nodes reached within ``max_cost``, one where it is 0. A text accepted gets the
canonical spelling. What the vocabulary does not know is looked up token by token in the
trie of the session's tokens, and tokens it does not know either are normalised by table.

Texts and tokens are routed by the hash of their class string, which no free move
changes; every shard holds only its part of a vocabulary, and a session of any size
spreads over all tasks. Only with ``max_cost`` above 0, where an accepted text may have
another hash, are texts spread by salt, with their session's vocabulary in each salt.

Defined results: null and blank texts match nothing and keep their value (null or
blank); a null session matches nothing; of several vocabulary lines that look alike the
smallest is canonical; a text that is itself in the vocabulary stays as it is; an empty
vocabulary leaves only the table; repeated rows each get their own result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glyphtrail.context import cut_lineage

# Letters of other scripts and the Latin letter each looks like.
LOOKALIKES = {
    "cyrillic": ("аеорсхуіѕјһԁԛԝӏѵүɡАВЕКМНОРСТХУІЅЈҺԚԜӀҮԌ", "aeopcxyisjhdqwlvygABEKMHOPCTXYISJhQWIYG"),
    "greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϳϲι", "ABEZHIKMNOPTYXovpjci"),
    "armenian": ("օսհոցզՏՕԼ", "ouhngqSOL"),
    "cherokee": ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᏀ", "ABCDEHJKLMPRSTVWZG"),
    "coptic": ("ⲀⲂⲤⲈⲎⲒⲔⲘⲚⲞⲢⲦⲨⲬⲌⲟⲣⲥ", "ABCEHIKMNOPTYXZopc"),
    "lisu": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
}
_PLAIN = {a: b for left, right in LOOKALIKES.values() for a, b in zip(left, right)}
#: Compatibility forms that look different from their plain letters.
_VISIBLE_FORMS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
#: Visible although of the format category.
_VISIBLE_FORMATS = set("؀؁؂؃؄؅۝܏࣢")
_FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}


def _invisible(c: str) -> bool:
    code, kind = ord(c), unicodedata.category(c)
    if kind == "Cf":
        return c not in _VISIBLE_FORMATS
    return (kind == "Cc" and c not in "\t\n\r\x0b\x0c\x85") or code in _FILLERS or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF


@lru_cache(maxsize=100_000)
def _classes(c: str, script_free: bool = True) -> str:
    """What one decomposed character is read as: its classes, empty for an ignorable."""
    if _invisible(c):
        return ""
    if c in "\t\n\r\x0b\x0c\x85  " or unicodedata.category(c) == "Zs":
        return " "
    form = unicodedata.decomposition(c).split(" ")[0]
    if form.startswith("<") and form not in _VISIBLE_FORMS:
        wide = unicodedata.normalize("NFKD", c)
        if wide != c:
            return "".join(_classes(x, script_free) for x in wide)
    return _PLAIN.get(c, c) if script_free else c


def fold(text: str) -> str:
    """The class string of ``text``: equal for texts that look the same."""
    if text.isascii() and text.isprintable():
        return text
    read = "".join(map(_classes, unicodedata.normalize("NFD", text)))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", read))


#: The usual letter of a script for each Latin one; the first listed wins.
_BACK: dict[str, dict[str, str]] = {script: {b: a for a, b in reversed(list(zip(*LOOKALIKES[script])))} for script in ("cyrillic", "greek")}


def _own_script(token: str) -> str | None:
    """The script of the letters of ``token`` that no other script shares."""
    counts: dict[str, int] = {}
    for c in token:
        if c.isalpha() and c not in _PLAIN and not ("a" <= c.lower() <= "z"):
            script = unicodedata.name(c, "?").split(" ")[0].lower()
            counts[script] = counts.get(script, 0) + 1
    return max(counts, key=counts.get) if counts else None


def normalise_token(token: str) -> str:
    """``token`` by table alone: plain width, composed, visible, in one script."""
    plain = "".join(_classes(c, False) for c in unicodedata.normalize("NFD", token))
    script = _own_script(plain)
    if script in _BACK:
        back = _BACK[script]
        plain = "".join(back.get(_PLAIN.get(c, c), c) if c in _PLAIN or c in back else c for c in plain)
    elif any("a" <= c.lower() <= "z" or "LATIN" in unicodedata.name(c, "") for c in plain):
        plain = "".join(_PLAIN.get(c, c) for c in plain)
    return unicodedata.normalize("NFC", plain)


#: Costs of visible edits: letters that differ in case only, and all others.
WEIGHTS = {"case": 1.0, "replace": 1.0, "insert": 1.0, "delete": 1.0}


def _change(x: str, c: str) -> float:
    """Cost of reading class ``x`` where the vocabulary has ``c``."""
    return 0.0 if x == c else WEIGHTS["case"] if x.lower() == c.lower() else WEIGHTS["replace"]


class Trie:
    """Vocabulary lines by class string; the canonical spelling is at the end node."""

    END = ""

    def __init__(self, lines: Iterator[str] | list[str] = ()) -> None:
        self.root: dict = {}
        for line in lines:
            self.add(line)

    def add(self, line: str) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", fold(line)):
            node = node.setdefault(c, {})
        node[self.END] = min(node.get(self.END, line), line)

    def find(self, text: str, max_cost: float = 0) -> tuple[str, float] | None:
        """The cheapest vocabulary line within ``max_cost`` and its cost, smallest first."""
        states = {id(self.root): (0.0, self.root)}
        if max_cost:
            self._skip(states, max_cost)
        for raw in text if text.isascii() else unicodedata.normalize("NFD", text):
            for x in _classes(raw):  # none for an invisible character: states stay
                states = self._read(states, x, max_cost)
                if not states:
                    return None
        ends = [(cost, node[self.END]) for cost, node in states.values() if self.END in node]
        cost, line = min(ends, default=(0.0, None))
        return None if line is None else (line, cost)

    def _read(self, states: dict, x: str, max_cost: float) -> dict:
        """The states after one class ``x`` of the text."""
        if not max_cost:
            return {id(child): (0.0, child) for _, node in states.values() if (child := node.get(x)) is not None}
        out: dict = {}
        for cost, node in states.values():
            self._reach(out, node, cost + WEIGHTS["delete"], max_cost)
            for c, child in node.items():
                if c != self.END:
                    self._reach(out, child, cost + _change(x, c), max_cost)
        self._skip(out, max_cost)
        return out

    @staticmethod
    def _reach(states: dict, node: dict, cost: float, max_cost: float) -> bool:
        if cost > max_cost or (id(node) in states and states[id(node)][0] <= cost):
            return False
        states[id(node)] = (cost, node)
        return True

    def _skip(self, states: dict, max_cost: float) -> None:
        """Adds the states that pass over characters which the text lacks."""
        todo = list(states.values())
        while todo:
            cost, node = todo.pop()
            for c, child in node.items():
                if c != self.END and self._reach(states, child, cost + WEIGHTS["insert"], max_cost):
                    todo.append(states[id(child)])


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        routes = [xxhash.xxh64_intdigest(fold(t)) >> 1 for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(routes, pa.int64())], names=[*batch.schema.names, "route"])


def _through(lines: DataFrame, texts: DataFrame, max_cost: float, salts: int) -> DataFrame:
    """(k, s, form) of the texts (k, s) that a line (k, s) accepts; lines come as they are."""
    both = lines.select(F.lit(0).alias("side"), "k", "s").unionByName(texts.select(F.lit(1).alias("side"), "k", "s"))
    if max_cost:
        copies = F.when(F.col("side") == 0, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.pmod(F.xxhash64("s"), F.lit(salts)).cast("int")))
        routed = both.withColumn("route", F.explode(copies)).withColumn("route", F.col("route").cast("long"))
    else:
        routed = both.mapInArrow(_route, "side int, k string, s string, route long")
    placed = routed.repartition("k", "route").sortWithinPartitions("k", "route", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, trie = None, set(), Trie()
        for batch in batches:
            rows = []
            for side, *here, s in zip(*(batch.column(c).to_pylist() for c in ("side", "k", "route", "s"))):
                if here != at:
                    at, known, trie = here, set(), Trie()
                if side == 0:
                    if s not in known:
                        known.add(s)
                        trie.add(s)
                elif s in known:
                    rows.append((here[0], s, s))
                elif known and (hit := trie.find(s, max_cost)):
                    rows.append((here[0], s, hit[0]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 3)], names=["k", "s", "form"])

    return placed.mapInArrow(run, "k string, s string, form string")


@F.pandas_udf(StringType())
def _by_table(tokens: pd.Series) -> pd.Series:
    return tokens.map(normalise_token)


#: Characters that are read as a space.
_GAPS = r"[\p{Z}\t\n\r\x0B\x0C\x85]"


def canonical_texts(texts: DataFrame, vocabulary: DataFrame, key: str, text: str, line: str, *, max_cost: float = 0, salts: int = 16, matched_only: bool = False) -> DataFrame:
    """Rows (key, text, form, matched) for every distinct (key, text) of ``texts``.

    ``vocabulary`` has the same key column and the lines in column ``line``. With
    ``matched_only`` texts that no line accepts are left out, and so are texts that are
    a vocabulary line themselves. Without it the others are put together again from
    their tokens, each by the token vocabulary of its session or by table.
    """
    blank = r"(?U)^[\s\p{Cf}\p{Cc}]*$"
    distinct = texts.select(F.col(key).alias("k"), F.col(text).alias("s")).where(F.col("k").isNotNull() & F.col("s").isNotNull() & ~F.col("s").rlike(blank)).distinct()
    lines = vocabulary.select(F.col(key).alias("k"), F.col(line).alias("s")).where(F.col("k").isNotNull() & F.col("s").isNotNull())
    hits = _through(lines, distinct, max_cost, salts)
    if matched_only:
        out = hits.where("s <> form").withColumn("matched", F.lit(True))
    else:
        hits = cut_lineage(hits)
        # A text's tokens go under two hashes of it, so that no row of a token holds the text.
        name = ["k", "h0", "h1"]
        rest = distinct.join(hits, ["k", "s"], "left_anti").select("k", F.xxhash64("s").alias("h0"), F.xxhash64(F.lit(1), "s").alias("h1"), "s")
        spots = rest.select(*name, F.posexplode(F.split(F.regexp_replace("s", _GAPS, " "), " ")).alias("place", "token"))
        words = lines.select("k", F.explode(F.split(F.regexp_replace("s", _GAPS, " "), " ")).alias("s")).where("s <> ''").distinct()
        seen = spots.select("k", F.col("token").alias("s")).where("s <> ''").distinct()
        forms = _through(words, seen, 0, salts).withColumnRenamed("s", "token")
        spelled = spots.join(forms, ["k", "token"], "left").withColumn("form", F.coalesce("form", F.when(F.col("token") == "", "").otherwise(_by_table("token"))))
        order = F.array_sort(F.collect_list(F.struct("place", "form")))
        built = spelled.groupBy(*name).agg(F.array_join(F.transform(order, lambda x: x["form"]), " ").alias("form"))
        built = rest.join(built, name).select("k", "s", "form", F.lit(False).alias("matched"))
        out = hits.withColumn("matched", F.lit(True)).unionByName(built)
    return out.select(F.col("k").alias(key), F.col("s").alias(text), "form", "matched")
