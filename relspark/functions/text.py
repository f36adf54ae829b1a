"""Text normalisation as column expressions; HTML entities and polymorphic metadata by Arrow UDFs."""

from __future__ import annotations

import html
import json
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space as Unicode and Python see it; Java's own class lacks the four separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"
TOKEN = "[a-zA-ZÀ-ÿ0-9_]+"
MODEL_CHARS, LEXICAL_CHARS, CELL_CHARS, CONTENT_CHARS, CONTENT_ROWS = 2_048, 20_000, 500, 100_000, 25


def squeezed(x: Column) -> Column:
    """White space collapsed to single blanks, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), SPACE, " "))


def clipped(x: Column, n: int) -> Column:
    return F.substring(F.coalesce(x, F.lit("")), 1, n)


def document_text(x: Column) -> Column:
    """The normalised text, whole."""
    return squeezed(x)


def model_text(x: Column) -> Column:
    """What of a normalised text an embedding model is given."""
    return clipped(squeezed(x), MODEL_CHARS)


def query_text(x: Column) -> Column:
    """Lower case; runs of dots, marks and # shortened; blanks set right around punctuation."""
    x = F.lower(F.coalesce(x.cast("string"), F.lit("")))
    rules = (
        (r"\.{3,}", "..."),
        (r"(?<![!?])!+\?[!?]*", "!?"),
        (r"(?<![!?])\?+![!?]*", "?!"),
        (r"!{2,}", "!"),
        (r"\?{2,}", "?"),
        (r"#{2,}", "#"),
        (r"(?U)\s{1,10}([.,:;!?)\]])", "$1"),
        (r"(?U)(?<=\d)(°)(?=\w)", "$1 "),
        (r"(?U)(?<!\d)([.,:;!?)])(?=[^\s.,:;!?)])", "$1 "),
        (r"(?U)(\w)([¿¡#(])", "$1 $2"),
        (r"(?U)([¿¡#(])\s+", "$1"),
    )
    for pattern, to in rules:
        x = F.regexp_replace(x, pattern, to)
    return squeezed(x)


def without_markup(x: Column) -> Column:
    """Tags, then URLs, replaced by blanks."""
    return F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"(?U)[hH][tT][tT][pP][sS]?://\S+|[wW][wW][wW]\.\S+", " ")


@F.pandas_udf(StringType())
def unescaped(x: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return x.fillna("").map(html.unescape)


def tokens(x: Column, stopwords: Sequence[str] = (), least: int = 2) -> Column:
    """Lower-case tokens of at least `least` characters that are no stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(TOKEN), F.lit(0))
    keep = F.filter(found, lambda t: F.length(t) >= least)
    return F.filter(keep, lambda t: ~t.isin(*stopwords)) if stopwords else keep


@F.pandas_udf(StringType())
def without_accents(x: pd.Series) -> pd.Series:
    """Text without combining marks, compatibility forms unfolded."""
    return x.fillna("").map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@dataclass(frozen=True)
class Analyzer:
    """What an index term goes through; a morphology is a function from a token list to a token list, run on Arrow batches.

    Built-in expressions do everything but entities, accents and morphology, each of which is only planned if asked for.
    Whole texts are analysed unless `chars` says how many characters (LEXICAL_CHARS is the usual clip).
    """

    stopwords: tuple[str, ...] = ()
    entities: bool = True
    markup: bool = True
    accents: bool = True
    numbers: bool = True
    least: int = 2
    morphology: Callable[[list[str]], list[str]] | None = None
    chars: int | None = None

    @property
    def whole(self) -> bool:
        """Whether the tokens are all runs of TOKEN in `lowered` texts, of `least` characters or more."""
        return self.accents and self.numbers and not self.stopwords and self.morphology is None

    def lowered(self, df: DataFrame, fields: Sequence[str]) -> DataFrame:
        """df with the lower-case texts that the tokens of its fields are taken from. Patterns only run over texts that
        have what a match can't do without."""
        clip = {f: F.coalesce(F.col(f) if self.chars is None else clipped(F.col(f), self.chars), F.lit("")) for f in fields}
        df = df.withColumns({f: F.lower(unescaped(x) if self.entities else x) for f, x in clip.items()})
        if not self.markup:
            return df
        marked = lambda x: x.contains("<") | x.contains("://") | x.contains("www.")
        return df.withColumns({f: F.when(marked(F.col(f)), without_markup(F.col(f))).otherwise(F.col(f)) for f in fields})

    def __call__(self, x: Column) -> Column:
        x = x if self.chars is None else clipped(x, self.chars)
        x = unescaped(x) if self.entities else x
        x = without_markup(x) if self.markup else x
        found = tokens(x if self.accents else without_accents(x), (), self.least)
        found = found if self.numbers else F.filter(found, lambda t: ~t.rlike("^[0-9]+$"))
        found = F.filter(found, lambda t: ~t.isin(*self.stopwords)) if self.stopwords else found
        if self.morphology is None:
            return found
        change = self.morphology
        lemmas = F.pandas_udf(lambda s: s.map(lambda ts: [t.lower() for t in change(list(ts))]), ArrayType(StringType()))
        return lemmas(found)


def singular(word: str) -> str:
    """The S-stemmer of Harman (1991), for English: only plural endings go. An Analyzer's morphology for whole lists is
    `singulars`."""
    if len(word) > 3 and word.endswith("ies") and word[-4] not in "ae":
        return word[:-3] + "y"
    if len(word) > 3 and word.endswith("es") and word[-3] not in "aeo":
        return word[:-1]
    return word[:-1] if len(word) > 2 and word.endswith("s") and word[-2] not in "us" else word


def singulars(words: list[str]) -> list[str]:
    return [singular(w) for w in words]


def read_stopwords(text: str) -> tuple[str, ...]:
    """Words of a stopword file's text: one a line, # starts a comment."""
    return tuple(dict.fromkeys(w.lower() for line in text.splitlines() if (w := line.partition("#")[0].strip())))


def lexical_tokens(x: Column, stopwords: Sequence[str] = (), entities: bool = True) -> Column:
    """Tokens by an Analyzer without morphology."""
    return Analyzer(tuple(stopwords), entities)(x)


def blank(x: Column) -> Column:
    return x.isNull() | (squeezed(x) == "")


def pair_key(id_query: Column, id_dataset: Column) -> Column:
    return F.concat_ws("||", F.trim(id_query.cast("string")), F.trim(id_dataset))


def parsed_pair(key: Column) -> Column:
    """struct<id_query, id_dataset> of a key with exactly one separator and no blank side; else null."""
    parts = F.split(key, r"\|\|", -1)
    ok = (F.size(parts) == 2) & (F.trim(parts[0]) != "") & (F.trim(parts[1]) != "")
    return F.when(ok, F.struct(F.trim(parts[0]).alias("id_query"), F.trim(parts[1]).alias("id_dataset")))


def strict_bool(x: Column) -> Column:
    """true and false in any case, blanks around; anything else is null."""
    low = F.lower(F.trim(x))
    return F.when(low == "true", True).when(low == "false", False)


def cleaned_output(x: Column) -> Column:
    """The JSON object in a model's answer: no code fence, from the first { to the last }, no trailing commas."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?iU)^```(?:json)?\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s*```$", ""), r"(?U)^\s+|\s+$", "")
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, "\n", " "), "\r", ""), r"(?U),\s*\}", "}"), r"(?U),\s*\]", "]")
    return F.when(inner == "", t).otherwise(F.trim(flat))


def header_line(names: Column, delimiter: Column) -> Column:
    """Column names joined by the delimiter, quoted where they hold a blank, separator or quote."""
    clean = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")
    quoted = F.transform(clean, lambda n: F.when(n.rlike('[ ;,"]'), F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n))
    return F.array_join(F.transform(quoted, lambda n, i: F.when(i > 0, F.concat(delimiter, n)).otherwise(n)), "")


def composed_content(rows: Column, columns: Column) -> Column:
    a, b = F.trim(F.coalesce(rows, F.lit(""))), F.trim(F.coalesce(columns, F.lit("")))
    return F.when((a == "") | (a == b), b).when(b == "", a).otherwise(F.concat(a, F.lit("\n"), b))


def localized(value: object, languages: Sequence[str]) -> str:
    """The text of a metadata value: a string, a {language: text} object, a {language, value} object, or a list of such."""

    def texts(x: object):
        if isinstance(x, str):
            yield x.strip()
        elif isinstance(x, dict) and x.get("value"):
            yield str(x["value"]).strip()
        elif isinstance(x, list):
            for y in x:
                if not isinstance(y, list):
                    yield from texts(y)

    def choices():
        if isinstance(value, dict):
            if "language" in value and "value" in value:
                yield str(value["value"] or "").strip()
            for x in [*(value.get(n) for n in languages), *value.values()]:
                if isinstance(x, str | list):
                    yield from texts(x)
        elif isinstance(value, list):
            for n in languages:
                yield from (t for x in value if isinstance(x, dict) and x.get("language") == n for t in texts(x))
            yield from texts(value)
        else:
            yield from texts(value)

    return next((t for t in choices() if t), "")


def multilingual(raw: Column, languages: Sequence[str] = ("es", "en")) -> Column:
    """localized() of a column of JSON texts; one that isn't JSON counts as a string."""

    @F.pandas_udf(StringType())
    def pick(x: pd.Series) -> pd.Series:
        def one(t: str | None) -> str:
            try:
                return localized(json.loads(t), languages) if t is not None else ""
            except ValueError:
                return t.strip()

        return x.map(one)

    return pick(raw)


@F.pandas_udf(StringType())
def canonical_json(x: pd.Series) -> pd.Series:
    """JSON texts with keys sorted at every depth; null and bad ones as {}."""

    def one(t: str | None) -> str:
        try:
            return json.dumps(json.loads(t), sort_keys=True) if t is not None else "{}"
        except ValueError:
            return "{}"

    return x.map(one)


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
