"""Pairs of a table that score at least so much, found by an index of q-grams instead of scoring all pairs.

What an alignment may lose against M for each pair of symbols is bounded by the score that is asked for: B = M (n + m) / 2 - t. A
mismatch costs M - X of it, a gap of k symbols k (M / 2 - E) - O, and destroys so many q-grams at most; so strings of n and m
symbols share all q-grams of either but B times the worst of those rates. A string sends its rarest q-grams, one more than can
be destroyed at all, and meets those that share one of them. Frequent q-grams are dealt into blocks, each two of which meet in a
group of their own. What meets is counted in whole, and only what shares enough reaches the score kernel. Strings of which
all q-grams can be destroyed meet each other by blocks of rows.

Strings whose budget leaves room for one change at most don't need q-grams to meet each other: each distinct text sends itself
with every symbol marked in turn, and without it where a gap is affordable, and texts that can score so much send the same
string. A group holds texts that differ in one place only, however many q-grams all texts share.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, hof
from ..scheme import DEFAULT, ScoringScheme
from .pairwise import PAIR_ROWS, all_pairs

Q = 3
#: Strings of a block that share a q-gram. A q-gram is frequent if it is more than one in FREQUENT of all, so there are fewer of those.
BLOCK, FREQUENT = 500, 1000
#: What stands for a changed symbol, and the symbols of the longest string that is sent with each of them changed.
MARK, NEAR = "\uffff", 256


@dataclass(frozen=True)
class Rates:
    """q-grams destroyed for what an alignment may lose: of a pair's budget, and of M n - t for a string of n symbols whatever its partner."""

    pair: Fraction
    alone: Fraction


def rates(scheme: ScoringScheme, q: int) -> Rates | None:
    """None where q-grams bound nothing: a mismatch or a gap that costs nothing against a match."""
    m, x, e, o = scheme.match, scheme.mismatch, scheme.gap_extend, scheme.gap_open
    if m <= x or m <= 2 * e or m < 0 or e > 0:
        return None
    change, symbol, run = Fraction(m - x), Fraction(m, 2) - e, Fraction(-o)
    pair = max(q / change, q / (symbol + run), 1 / symbol)
    # as the shorter string: its partner's further symbols are paid for, but may lie in several gaps, each of which is opened
    short = []
    if run:
        short.append(max(q / change, 1 / (2 * symbol), (q - 1) / run))
    if e:
        short.append(pair * (1 + Fraction(m, -2 * e)))  # they are no more than the score leaves room for
    return Rates(pair, max(pair, min(short))) if short else None


def qgrams(text: Column, q: int = Q) -> Column:
    """The distinct runs of q symbols of a string."""
    s = hof.symbols(text)
    return F.array_distinct(F.transform(hof.positions(F.size(s) - q + 1), lambda i: F.array_join(F.slice(s, i, q), "")))


def _times(rate: Fraction, budget: Column) -> Column:
    """The whole part of a rate times a budget that isn't negative, in whole numbers."""
    return F.floor(budget.cast("bigint") * rate.numerator / rate.denominator + F.lit(1e-9)).cast("int")


def _strings(df: DataFrame, key: str, sequence: str, at_least: int, scheme: ScoringScheme, rate: Rates, q: int) -> DataFrame:
    """_r, _key, _n, _grams, _lost, _near of the strings that can reach the score at all."""
    n = F.char_length(sequence)
    own = df.where(F.col(sequence).isNotNull() & (n * scheme.match >= at_least))
    own = own.select(F.struct(*df.columns).alias("_r"), F.col(key).alias("_key"), n.alias("_n"), qgrams(F.col(sequence), q).alias("_grams"))
    return own.withColumns({"_lost": _times(rate.alone, F.col("_n") * scheme.match - at_least), "_near": _near(F.col("_n"), at_least, scheme)})


def _costs(scheme: ScoringScheme) -> tuple[int, int, int]:
    """What a mismatch, a gap's opening and a symbol of its own that a string leaves unpaired take of M n - t at least, whatever its partner."""
    return scheme.match - scheme.mismatch, -scheme.gap_open, scheme.match - scheme.gap_extend


def _near(n: Column, at_least: int, scheme: ScoringScheme) -> Column:
    """Whether a string of n symbols can't afford two changes of its symbols."""
    change, run, symbol = _costs(scheme)
    return (n <= NEAR) & (n * scheme.match - at_least < min(2 * change, change + run + symbol, run + 2 * symbol))


def _near_texts(own: DataFrame, sequence: str, at_least: int, scheme: ScoringScheme) -> DataFrame:
    """_a, _b: each two different texts of _near strings that may score so much, once."""
    change, run, symbol = _costs(scheme)
    text, n = F.col("_t"), F.char_length("_t")
    left = n * scheme.match - at_least
    without = lambda i, put: F.xxhash64(F.concat(F.substr(text, F.lit(1), i - 1), F.lit(put), F.substr(text, i + 1)))
    each = lambda put, cost: F.when(left >= cost, F.array_distinct(F.transform(hof.positions(n), lambda i: without(i, put)))).otherwise(F.array().cast("array<bigint>"))
    sent = F.concat(F.array(F.xxhash64(text)), each(MARK, change), each("", run + symbol))
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given outright, as few bytes make much work here
    own = own.where("_near").select(F.col(f"_r.{sequence}").alias("_t")).repartition(parts, "_t").distinct().select("_t", F.explode(sent).alias("_v"))
    met = own.select(F.col("_t").alias("_a"), "_v").join(own.select(F.col("_t").alias("_b"), "_v"), "_v").where("_a < _b")
    return met.select("_a", "_b").repartition(parts, "_a", "_b").distinct()


def _rows_of(texts: DataFrame, own: DataFrame, sequence: str) -> DataFrame:
    """texts with x and y, each two _near rows that hold _a and _b, the one with the smaller key first."""
    own = own.where("_near").select("_key", "_r", F.col(f"_r.{sequence}").alias("_t"))
    half = lambda k, t: own.select(F.col("_key").alias(f"_k{k}"), F.col("_r").alias(f"_r{k}"), F.col("_t").alias(t))
    met = texts.join(half(1, "_a"), "_a").join(half(2, "_b"), "_b").where((F.col("_k1") < F.col("_k2")) | (F.col("_k1") > F.col("_k2")) & (F.col("_a") != F.col("_b")))
    first = F.col("_k1") < F.col("_k2")
    side = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return met.select(side("_r1", "_r2").alias("x"), side("_r2", "_r1").alias("y"), *[c for c in texts.columns if c not in ("_a", "_b")])


def _same(own: DataFrame, sequence: str) -> DataFrame:
    """_a, _b: each text of _near strings with itself."""
    return own.where("_near").select(F.col(f"_r.{sequence}").alias("_a"), F.col(f"_r.{sequence}").alias("_b")).distinct()


def _reach(n: Column, m: Column, scheme: ScoringScheme, at_least: int) -> Column:
    gap = F.when(n == m, 0).otherwise(F.abs(n - m) * scheme.gap_extend + scheme.gap_open)
    return F.least(n, m) * scheme.match + gap >= at_least


def _met(own: DataFrame, scheme: ScoringScheme, at_least: int, block: int) -> DataFrame:
    """k1, k2: keys of strings that share a q-gram among their rarest ones, each pair once; not two _near ones."""
    grams = own.select(F.explode("_grams").alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    total = grams.agg(F.coalesce(F.sum("_f"), F.lit(0))).first()[0]
    often = grams.where(F.col("_f") * FREQUENT > total).agg(F.map_from_entries(F.collect_list(F.struct("_g", "_f"))).alias("_often"))  # one row, fewer than FREQUENT entries
    by = F.array_sort(F.transform("_grams", lambda g: F.struct(F.coalesce(F.element_at("_often", g), F.lit(0)).alias("f"), F.xxhash64(g).alias("h"), g.alias("g"))))
    rare = own.crossJoin(F.broadcast(often)).select("_key", "_n", "_near", F.explode(F.slice(by, 1, F.col("_lost") + 1)["g"]).alias("_g"))
    far = rare.where("NOT _near")
    many = far.groupBy("_g").agg(F.count(F.lit(1)).alias("_f")).where(F.col("_f") > block).select("_g", F.ceil(F.col("_f") / block).cast("int").alias("_blocks"))

    def dealt(d: DataFrame) -> DataFrame:
        d = d.join(many, "_g", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))  # Spark sends many to all where its size allows
        return d.withColumn("_b", F.pmod(F.xxhash64("_key"), "_blocks").cast("int"))

    far, near = dealt(far), dealt(rare.where("_near"))
    side = lambda d, names, first, last: d.select("_g", F.col("_b"), F.explode(F.sequence(first, last)).alias("_c"), F.col("_key").alias(names[0]), F.col("_n").alias(names[1]))
    x = side(far, ("_kx", "_nx"), F.col("_b"), F.col("_blocks") - 1).select("_g", F.col("_b").alias("_i"), F.col("_c").alias("_j"), "_kx", "_nx")
    y = side(far, ("_ky", "_ny"), F.lit(0), F.col("_b")).select("_g", F.col("_c").alias("_i"), F.col("_b").alias("_j"), "_ky", "_ny")
    met = x.join(y, ["_g", "_i", "_j"]).where((F.col("_kx") != F.col("_ky")) & ((F.col("_i") < F.col("_j")) | (F.col("_kx") < F.col("_ky")))).select("_kx", "_nx", "_ky", "_ny")
    x = far.select("_g", F.col("_b").alias("_c"), F.col("_key").alias("_kx"), F.col("_n").alias("_nx"))
    y = side(near, ("_ky", "_ny"), F.lit(0), F.col("_blocks") - 1).select("_g", "_c", "_ky", "_ny")
    met = met.unionByName(x.join(y, ["_g", "_c"]).where(F.col("_kx") != F.col("_ky")).select("_kx", "_nx", "_ky", "_ny"))
    met = met.where(_reach(F.col("_nx"), F.col("_ny"), scheme, at_least))
    return met.select(F.least("_kx", "_ky").alias("k1"), F.greatest("_kx", "_ky").alias("k2")).distinct()


def _open_pairs(own: DataFrame, scheme: ScoringScheme, at_least: int) -> DataFrame:
    """x, y of strings all of whose q-grams can be destroyed, not two _near ones: blocks of the others meet each other and all _near ones."""
    own = own.where(F.size("_grams") <= F.col("_lost")).select("_key", "_n", "_r", "_near")
    far, near = own.where("NOT _near"), own.where("_near")
    blocks = max(1, -(-far.count() // PAIR_ROWS))
    one = far.select(F.col("_key").alias("_kx"), F.col("_n").alias("_nx"), F.col("_r").alias("_rx"), F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int").alias("_c"))
    two = near.select(F.col("_key").alias("_ky"), F.col("_n").alias("_ny"), F.col("_r").alias("_ry"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_c"))
    met = one.join(two, "_c").where((F.col("_kx") != F.col("_ky")) & _reach(F.col("_nx"), F.col("_ny"), scheme, at_least))
    first = F.col("_kx") < F.col("_ky")
    met = met.select(F.when(first, F.col("_rx")).otherwise(F.col("_ry")).alias("x"), F.when(first, F.col("_ry")).otherwise(F.col("_rx")).alias("y"))
    both = all_pairs(far.select("_r", "_key", "_n"), "_key").where(_reach(F.col("x._n"), F.col("y._n"), scheme, at_least))
    return met.unionByName(both.select(F.col("x._r").alias("x"), F.col("y._r").alias("y")))


def _by_grams(own: DataFrame, sequence: str, at_least: int, scheme: ScoringScheme, rate: Rates, block: int) -> DataFrame | None:
    """x, y of rows that share enough q-grams or may share none, one of which at least is not _near; None if all are."""
    if own.where("NOT _near").isEmpty():
        return None
    n, m = F.char_length(f"x.{sequence}"), F.char_length(f"y.{sequence}")
    open_ = F.size("_grams") <= F.col("_lost")
    half = lambda name, k: own.select(F.col("_key").alias(k), F.col("_r").alias(name), F.col("_grams").alias(f"_g{name}"), open_.alias(f"_o{name}"))
    met = _met(own, scheme, at_least, block).join(half("x", "k1"), "k1").join(half("y", "k2"), "k2").where(~(F.col("_ox") & F.col("_oy")))
    budget = (n + m) * scheme.match - 2 * at_least
    shared = F.size(F.array_intersect("_gx", "_gy"))
    enough = shared >= F.greatest(F.size("_gx"), F.size("_gy")) - _times(rate.pair / 2, budget)
    return met.where(enough).select("x", "y").unionByName(_open_pairs(own, scheme, at_least))


def candidates(df: DataFrame, key: str, sequence: str, at_least: int, scheme: ScoringScheme = DEFAULT, q: int = Q, block: int = BLOCK) -> DataFrame:
    """x, y: structs of df's columns, of each two rows that may score at_least, the one with the smaller key first. key is
    unique. All others are proven not to; rows with a null sequence or key are in no pair."""
    rate = rates(scheme, q)
    if rate is None:
        return all_pairs(df.where(F.col(sequence).isNotNull()), key).where(hof.upper_bound(F.col(f"x.{sequence}"), F.col(f"y.{sequence}"), scheme) >= at_least)
    own = _strings(df.where(F.col(key).isNotNull()), key, sequence, at_least, scheme, rate, q)
    near = _rows_of(_near_texts(own, sequence, at_least, scheme).unionByName(_same(own, sequence)), own, sequence)
    rest = _by_grams(own, sequence, at_least, scheme, rate, block)
    return near if rest is None else near.unionByName(rest)


def score_join(df: DataFrame, key: str, sequence: str, at_least: int, scheme: ScoringScheme = DEFAULT, q: int = Q, block: int = BLOCK) -> DataFrame:
    """x, y, global_score, max_cell_score of all pairs of rows that score at_least: those of all_pairs() and score_pairs().

    Texts that meet by their changes are scored once, however many rows hold them."""

    def scored(pairs: DataFrame, a: str, b: str, *columns: str) -> DataFrame:
        d = pairs.withColumn("_s", arrow.scores(F.col(a), F.col(b), scheme, once=True))
        return d.select(*columns, "_s.global_score", "_s.max_cell_score").where(F.col("global_score") >= at_least)

    rate = rates(scheme, q)
    if rate is None:
        return scored(candidates(df, key, sequence, at_least, scheme, q, block), f"x.{sequence}", f"y.{sequence}", "x", "y")
    own = _strings(df.where(F.col(key).isNotNull()), key, sequence, at_least, scheme, rate, q)
    texts = _near_texts(own, sequence, at_least, scheme)
    if key != sequence:  # else rows of one text are no pair
        texts = texts.unionByName(_same(own, sequence))
    near = _rows_of(scored(texts, "_a", "_b", "_a", "_b"), own, sequence)
    rest = _by_grams(own, sequence, at_least, scheme, rate, block)
    return near if rest is None else near.unionByName(scored(rest, f"x.{sequence}", f"y.{sequence}", "x", "y"))
