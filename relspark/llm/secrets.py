"""Secret scans: fixed patterns, and Shannon entropy over sliding windows of candidate strings.

All of it is column expressions: no shuffle, no Python. A text that holds no match of a pattern costs one pass of that
pattern. A window's entropy is kept by counts: moving it on changes the count of the character that enters and of the
one that leaves, and the sum of c * log2(c), held as whole numbers so that nothing drifts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .syncmers import let

#: Kinds with their pattern, the group that must be long, and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of at least `window` characters of the alphabet; windows with `bits` or more are secret."""

    kind: str
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return "[" + self.alphabet.replace("-", r"\-") + "]{%d,}" % self.window


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (CharacterClass("entropy_hex", DIGITS + LOWER[:6] + UPPER[:6], 20, 3.05), CharacterClass("entropy_base64", DIGITS + LOWER + UPPER + "+/_-", 24, 3.95))
#: A candidate that matches one of these is no secret by entropy: words without digits, placeholders, UUIDs, long runs of one character.
ALLOWED = (r"^[^0-9]*$", r"^[^A-Za-z]*$", r"(?i)example|sample|placeholder|dummy|xxxx|0123456789|abcdefgh", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(.)\1{7}")
#: Matches that are appended to one small array before it joins the others.
BLOCK = 128
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def _span(start: Column, kind_no: int, end: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind_no).alias("kind_no"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def _none() -> Column:
    return F.array().cast(SPAN)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<gap, whole, part>>: what stands before each leftmost match that doesn't overlap, the match, its group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    return F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))


def _walk(text: Column, pattern: str, group: int, spans: Callable[[Column, Column], Column]) -> Column:
    """The spans that spans(match, start) gives for each match, positions in code points.

    Matches are taken in blocks, so that appending to the result stays cheap in a text with very many.
    """

    def block(items: Column, n: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), _none().alias("found"))

        def step(s: Column, x: Column) -> Column:
            at = s["at"] + F.length(x["gap"])
            return F.struct((at + F.length(x["whole"])).alias("at"), F.concat(s["found"], spans(x, at)).alias("found"))

        return F.aggregate(F.slice(items, n * BLOCK + 1, F.lit(BLOCK)), start, step)

    def every(items: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

        def step(s: Column, n: Column) -> Column:
            return let(block(items, n, s["at"]), lambda b: F.struct(b["at"].alias("at"), F.when(F.size(b["found"]) > 0, F.concat(s["found"], F.array(b["found"]))).otherwise(s["found"]).alias("found")))

        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), start, step, lambda s: F.flatten(s["found"]))

    return F.when(text.rlike(pattern), let(_matches(text, pattern, group), every)).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans of BASE by start, then kind."""
    parts = [_walk(text, p, g, lambda x, at, n=n, kind=kind, least=least: F.when(F.length(x["part"]) >= least, F.array(_span(at, n, at + F.length(x["whole"]), kind))).otherwise(_none())) for n, (kind, p, g, least) in enumerate(BASE)]
    return F.array_sort(F.concat(*parts))


def _hot(candidate: Column, c: CharacterClass) -> Column:
    """struct<low, high>: start of the first and end of the last window of the candidate with the class's entropy; low is -1 without any."""
    w, slots = c.window, len(c.alphabet)
    cost = [round(k * math.log2(k) * 1e6) if k else 0 for k in range(w + 2)]
    most = math.floor((math.log2(w) - c.bits) * w * 1e6)
    f = F.array(*[F.lit(x) for x in cost])
    place = lambda i: F.instr(F.lit(c.alphabet), F.substring(candidate, i, F.lit(1)))
    start = F.struct(F.array_repeat(F.lit(0), slots).alias("n"), F.lit(0).alias("sum"), F.lit(-1).alias("low"), F.lit(-1).alias("high"))

    def step(s: Column, i: Column) -> Column:
        came, left = place(i), F.when(i > w, place(i - w)).otherwise(0)
        n_in = F.element_at(s["n"], came)
        n_out = F.when(left > 0, F.element_at(s["n"], F.greatest(left, F.lit(1)))).otherwise(0)
        moved = F.when(came == left, s["sum"]).otherwise(s["sum"] + F.get(f, n_in + 1) - F.get(f, n_in) + F.when(left > 0, F.get(f, n_out - 1) - F.get(f, n_out)).otherwise(0))
        n = F.transform(s["n"], lambda x, k: x + F.when(k == came - 1, 1).otherwise(0) - F.when(k == left - 1, 1).otherwise(0))
        hot = (i >= w) & (moved <= most)
        return F.struct(n.alias("n"), moved.alias("sum"), F.when(hot & (s["low"] < 0), i - w).otherwise(s["low"]).alias("low"), F.when(hot, i).otherwise(s["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.length(candidate)), start, step, lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high")))


def entropy_spans(text: Column, classes=CLASSES, allowed=ALLOWED) -> Column:
    """Spans of candidates of each class, from the first to the last window with enough entropy."""
    parts = []
    for n, c in enumerate(classes):

        def spans(x: Column, at: Column, n=n, c=c) -> Column:
            fine = F.lit(False)
            for p in allowed:
                fine = fine | x["whole"].rlike(p)
            found = F.transform(F.array(_hot(x["whole"], c)), lambda h: _span(at + h["low"], len(BASE) + n, at + h["high"], c.kind))
            return F.when(~fine, F.filter(found, lambda s: s["end"] > at)).otherwise(_none())

        parts.append(_walk(text, c.pattern, 0, spans))
    return F.concat(*parts)


def scanned(docs: DataFrame, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """docs (doc_id, text) with base and spans: arrays of (start, kind_no, end, kind) by start, then kind.

    Spans by entropy that lie within one of the base are left out. Null texts count as empty and have no spans;
    positions are in code points, ends exclusive; repeated rows stay; other columns are ignored.
    """
    df = docs.select("doc_id", text_of().alias("text")).withColumn("base", base_spans(F.col("text"))).withColumn("more", entropy_spans(F.col("text"), classes, allowed))
    new = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    return df.select("doc_id", "text", "base", F.array_sort(F.concat("base", new)).alias("spans"))


def all_spans(text: Column, classes=CLASSES, allowed=ALLOWED) -> Column:
    """Base spans and those by entropy, by start."""
    return F.array_sort(F.concat(base_spans(text), entropy_spans(text, classes, allowed)))


def without_secrets(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs, with all columns, and every span in text replaced by mark; n_chars follows, where there is one. Null texts stay null."""
    found = docs.withColumn("_secret_spans_", all_spans(text_of()))
    found = found.withColumn("text", F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col("_secret_spans_"), mark)))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("_secret_spans_") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each run of overlapping spans replaced by mark. Spans are by start."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        apart = x["start"] >= s["at"]
        gap = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(apart, F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
