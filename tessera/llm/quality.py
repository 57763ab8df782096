"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric is a built-in expression on the whole text. No user function runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words, written

#: Frequent function words of the languages in the corpus.
STOP_WORDS = (
    "the of and to in is it that for was on are as with be by at this from or an have not but "
    "der die das und von zu mit sich des auf für ist im dem nicht ein eine als auch den "
    "le la les de et en un une du que est pour qui dans pas sur par il au avec "
    "el los las y por con una para del se no su al lo como más "
).split()

#: The words as they stand in a text: lower case or capitalised, bare or before a comma or full stop.
STOP_FORMS = sorted({form + end for w in STOP_WORDS for form in (w, w.capitalize()) for end in ("", ",", ".")})

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


#: Low bits of a sorted long that hold a window's position; the rest holds its hash.
POSITION_BITS = 24

#: Words of a window whose distinct words are counted. Of a longer text's words fewer are distinct, however clean it is; of a window's it depends on the text alone.
WINDOW = 500


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; rules below min_words words are skipped."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Thresholds of the production query. They reject clear junk: tables and symbol soup,
#: texts made of repeated lines, single words said over and over, lists without function words.
RULES = (
    Rule("word_length", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("dup_line_ratio", None, 0.45, min_words=50),
    Rule("stop_ratio", 0.05, None, min_words=40),
    Rule("distinct_ratio", 0.1, None, min_words=100),
    Rule("adjacent_ratio", None, 0.3),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rest(array: Column, k: int) -> Column:
    """The array from its element k on."""
    return F.slice(array, k + 1, F.greatest(F.size(array) - k, F.lit(0)))


def _windows(h: Column) -> Column:
    """Hashes of all windows of five words, from those of the words. Pairs and fours come first; what pairs beyond the end give is cut off."""
    pair = lambda a, b: F.xxhash64(a, b)
    four = lambda h2: F.zip_with(h2, _rest(h2, 2), pair)
    return _let(F.zip_with(h, _rest(h, 1), pair), lambda h2: F.slice(F.zip_with(four(h2), _rest(h, 4), pair), 1, F.greatest(F.size(h) - 4, F.lit(0))))


def _repeated(w: Column, h5: Column) -> Column:
    """Words of w in windows that occur twice or more.

    Hash and position of a window share one long: sorted as numbers, repeated windows become
    neighbours, and their words are compared where hashes agree.
    """
    packed = F.transform(h5, lambda x, i: F.shiftleft(x, POSITION_BITS).bitwiseOR(i.cast("long")))
    key = lambda x: F.shiftright(x, POSITION_BITS)
    pos = lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
    differ = lambda i, j: reduce(lambda x, y: x | y, [F.get(w, i + k) != F.get(w, j + k) for k in range(5)])
    n = F.size(w)

    def covered(at: Column) -> Column:
        step = lambda s, k: s + F.least(F.lit(5), F.coalesce(F.get(at, k), F.lit(2**30)) - F.get(at, k - 1))
        return F.when(F.size(at) > 0, F.aggregate(F.sequence(F.lit(1), F.size(at)), F.lit(0), step)).otherwise(0)

    def by_words() -> Column:
        """Sorts the windows themselves: two different ones share a hash, or positions don't fit (they spoil hashes, so repeats may go unseen)."""
        window = lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(5)]).alias("t"), i.alias("i"))

        def marked(p: Column) -> Column:
            same = lambda j, k: F.get(p, j)["t"] == F.get(p, k)["t"]
            twice = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: ((k > 0) & same(k - 1, k)) | ((k < F.size(p) - 1) & same(k, k + 1)))
            return F.sort_array(F.transform(twice, lambda k: F.get(p, k)["i"]))

        return _let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 5), window)), marked)

    def from_sorted(s: Column, eq: Column) -> Column:
        pairs = F.zip_with(s, _rest(s, 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        clash = F.exists(F.zip_with(pairs, eq, lambda p, e: e & differ(pos(p["a"]), pos(p["b"]))), lambda x: x)
        after = F.concat(F.array(F.lit(False)), F.slice(eq, 1, F.size(eq) - 1))
        hit = F.zip_with(s, F.zip_with(eq, after, lambda a, b: a | b), lambda x, e: F.when(e, pos(x)))
        slow = (n >= 1 << POSITION_BITS) | clash
        at = F.when(slow, by_words()).otherwise(F.sort_array(F.filter(hit, lambda x: x.isNotNull())))
        return F.when((n >= 1 << POSITION_BITS) | F.array_contains(eq, True), _let(at, covered)).otherwise(0)

    equal = lambda s: F.zip_with(s, _rest(s, 1), lambda a, b: F.coalesce(key(a) == key(b), F.lit(False)))
    return F.when(F.size(h5) > 1, _let(F.sort_array(packed), lambda s: _let(equal(s), lambda eq: from_sorted(s, eq)))).otherwise(0)


def metrics(text: Column) -> Column:
    """All metrics of a text, as one struct expression."""

    def of_words(w: Column) -> Column:
        return _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: of_hashes(w, h))

    def of_hashes(w: Column, h: Column) -> Column:
        windows = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(w) / WINDOW).cast("int") - 1, F.lit(0)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _let(_windows(h), lambda h5: _repeated(w, h5)).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))).alias("n_stop_words"),
            F.aggregate(windows, F.lit(0), lambda s, k: s + F.size(F.array_distinct(F.slice(h, k * WINDOW + 1, WINDOW)))).alias("n_distinct_words"),
            F.size(F.filter(F.zip_with(h, _rest(h, 1), lambda a, b: a == b), lambda x: x)).alias("n_adjacent"),
        )

    return _let(words(text), of_words)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns nested in ``row``, and the metrics of each whole text.

    Null and empty texts have no words; all counts are 0 and ratios 0.

    The metrics are one expression, generated as the only element of an array: what is filtered,
    joined or grouped by them stays above that step, so they are computed once for each row.
    """
    t = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    out = docs.select(F.struct("*").alias("row")).select("row", F.explode(F.array(metrics(t))).alias("__m"))
    return out.select(
        "row", "__m.n_words", "__m.word_chars", "__m.n_symbols", F.col("__m.lines.dup").alias("n_dup_lines"), "__m.n_repeat_words",
        F.col("__m.lines.all").alias("n_lines"), "__m.n_stop_words", "__m.n_distinct_words", "__m.n_adjacent",
    )


#: Metrics that rules can name, as expressions on the columns of measure().
METRICS = {
    "n_words": lambda: F.col("n_words"),
    "word_length": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbol_ratio": lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "dup_line_ratio": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "stop_ratio": lambda: F.col("n_stop_words") / F.greatest("n_words", F.lit(1)),
    "distinct_ratio": lambda: F.col("n_distinct_words") / F.greatest("n_words", F.lit(1)),
    "adjacent_ratio": lambda: F.col("n_adjacent") / F.greatest("n_words", F.lit(1)),
}


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression that holds where every rule of the table is met."""
    tests = []
    for r in rules:
        m = METRICS[r.metric]()
        ok = reduce(lambda a, b: a & b, [t for t in (None if r.low is None else m >= r.low, None if r.high is None else m <= r.high) if t is not None], F.lit(True))
        tests.append((F.col("n_words") < r.min_words) | ok)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """measure() with base_failed and kept. Null or empty texts fail; repeated rows are judged alike."""
    m = measure(docs, text)
    return m.select("*", base_failed().alias("base_failed"), (~base_failed() & compile_rules(rules)).alias("kept"))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, that the rules keep."""
    return judge(docs, rules, text).where("kept").select("row.*")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """passing(), written and read again, where it is used more than once."""
    return written(passing(docs, rules, text), "passing")
