"""Alignment pieces as Catalyst expressions: no Python at run time. The score kernels grow with the product of the
lengths, interpreted, so they suit short strings; longer ones go to functions.arrow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..scheme import CELL_FLOOR, DEFAULT, DEFAULT_BLOCK, ScoringScheme

INT = "int"


def _i(x: int) -> Column:
    return F.lit(x).cast(INT)


def symbols(text: Column) -> Column:
    """The characters of a string; none for an empty one."""
    return F.when(F.char_length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def positions(n: Column) -> Column:
    """1 to n; none for 0."""
    return F.when(n > 0, F.sequence(_i(1), n.cast(INT))).otherwise(F.array().cast("array<int>"))


def boundary_row(m: Column, scheme: ScoringScheme = DEFAULT) -> Column:
    """Scores of aligning 0 to m symbols with nothing."""
    return F.transform(F.sequence(_i(0), m.cast(INT)), lambda j: F.when(j == 0, _i(0)).otherwise(_i(scheme.gap_open) + j * scheme.gap_extend))


def substitution_mask(a: Column, symbol: Column, scheme: ScoringScheme = DEFAULT) -> Column:
    """The score of each symbol of a against one symbol."""
    return F.transform(symbols(a), lambda c: F.when(c == symbol, _i(scheme.match)).otherwise(_i(scheme.mismatch)))


def scores(a: Column, b: Column, scheme: ScoringScheme = DEFAULT) -> Column:
    """struct(global_score, max_cell_score), bigint; null if either string is."""
    o, e = scheme.gap_open, scheme.gap_extend
    longer, shorter = F.when(F.char_length(a) >= F.char_length(b), a).otherwise(b), F.when(F.char_length(a) >= F.char_length(b), b).otherwise(a)
    m = F.char_length(longer)
    start = F.struct(
        boundary_row(m, scheme).alias("h"),
        F.transform(positions(m), lambda j: _i(2 * o + e) + j * e).alias("e"),
        _i(CELL_FLOOR).alias("best"),
        symbols(longer).alias("a"),
        positions(m).alias("at"),
        _i(0).alias("i"),
    )

    def row(acc: Column, c: Column) -> Column:
        i = acc["i"] + 1
        left = _i(o) + i * e

        def cell(s: Column, j: Column) -> Column:
            g = F.greatest(F.get(acc["h"], j - 1) + F.when(F.get(acc["a"], j - 1) == c, _i(scheme.match)).otherwise(_i(scheme.mismatch)), F.get(acc["e"], j - 1))
            return F.struct(F.greatest(s["top"], g - j * e).alias("top"), F.concat(s["row"], F.array(F.greatest(g, s["top"] + _i(o) + j * e))).alias("row"))

        h = F.aggregate(acc["at"], F.struct(left.alias("top"), F.array(left).alias("row")), cell, lambda s: s["row"])
        # one more step, so that the row is worked out once: it goes on as the state of a fold over a single element
        return F.aggregate(
            F.array(h),
            acc,
            lambda s, r: F.struct(
                r.alias("h"),
                F.zip_with(s["e"], F.slice(r, 2, F.size(s["at"])), lambda x, y: F.greatest(x, y + _i(o)) + _i(e)).alias("e"),
                F.greatest(s["best"], F.array_max(F.slice(r, 2, F.size(s["at"])))).alias("best"),
                s["a"].alias("a"),
                s["at"].alias("at"),
                (s["i"] + 1).alias("i"),
            ),
        )

    out = F.aggregate(symbols(shorter), start, row, lambda s: F.struct(F.element_at(s["h"], -1).cast("bigint").alias("global_score"), s["best"].cast("bigint").alias("max_cell_score")))
    return F.when(a.isNotNull() & b.isNotNull(), out)


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once: expressions in lambdas are evaluated wherever they stand."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _planes(longer: Column, shorter: Column, scheme: ScoringScheme) -> Column:
    """struct(h, best, planes): the last row of scores, the largest cell, and for each row of the matrix a byte a cell.

    A byte is 9 for the diagonal, 0 for a gap along the row and 18 for one along the column, whichever comes first among the
    best, and 3 and 1 times whether extending such a gap is worse than opening it (0), as good (1) or better (2).
    """
    o, e = scheme.gap_open, scheme.gap_extend
    m = F.char_length(longer)
    start = F.struct(
        boundary_row(m, scheme).alias("h"),
        F.transform(positions(m), lambda j: _i(2 * o + e) + j * e).alias("e"),
        _i(CELL_FLOOR).alias("best"),
        symbols(longer).alias("a"),
        positions(m).alias("at"),
        _i(0).alias("i"),
        F.array().cast("array<binary>").alias("planes"),
    )

    def row(acc: Column, c: Column) -> Column:
        left = _i(o) + (acc["i"] + 1) * e

        def cell(s: Column, j: Column) -> Column:
            d = F.get(acc["h"], j - 1) + F.when(F.get(acc["a"], j - 1) == c, _i(scheme.match)).otherwise(_i(scheme.mismatch))
            ways = F.struct(d.alias("d"), F.get(acc["e"], j - 1).alias("up"), (s["top"] + _i(o) + j * e).alias("f"))

            def best(w: Column) -> Column:
                v = F.greatest(w["d"], w["up"], w["f"])
                return _let(v, lambda v: F.struct(F.greatest(s["top"], F.greatest(w["d"], w["up"]) - j * e).alias("top"), F.concat(s["row"], F.array(v)).alias("row"), F.concat(s["bytes"], F.char(code(w, v))).alias("bytes")))

            def code(w: Column, v: Column) -> Column:
                compared = lambda gap: F.signum(w[gap] - v - o).cast(INT) + 1
                return (_i(48) + F.when(v == w["d"], _i(9)).when(v == w["f"], _i(0)).otherwise(_i(18)) + compared("f") * 3 + compared("up")).cast("bigint")

            return _let(ways, best)

        def entered(r: Column) -> Column:
            inside = F.slice(r["row"], 2, F.size(acc["at"]))
            return F.struct(
                r["row"].alias("h"),
                F.zip_with(acc["e"], inside, lambda x, y: F.greatest(x, y + _i(o)) + _i(e)).alias("e"),
                F.greatest(acc["best"], F.array_max(inside)).alias("best"),
                acc["a"].alias("a"),
                acc["at"].alias("at"),
                (acc["i"] + 1).alias("i"),
                F.concat(acc["planes"], F.array(r["bytes"].cast("binary"))).alias("planes"),
            )

        return _let(F.aggregate(acc["at"], F.struct(left.alias("top"), F.array(left).alias("row"), F.lit("").alias("bytes")), cell), entered)

    return F.aggregate(symbols(shorter), start, row, lambda s: F.struct(F.element_at(s["h"], -1).alias("total"), s["best"].alias("best"), s["planes"].alias("planes")))


def aligned(a: Column, b: Column, scheme: ScoringScheme = DEFAULT) -> Column:
    """struct(global_score, max_cell_score, swapped, row_a, row_b, ops), the same alignment that functions.arrow.aligned()
    finds, in two folds: one over the rows, which leaves a byte a cell, and one over the steps of the walk back. Null if either
    string is. Costs grow as those of scores(), for short strings."""
    swapped = F.char_length(b) > F.char_length(a)
    longer, shorter = F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b)
    n, m = F.char_length(shorter), F.char_length(longer)

    def walked(p: Column) -> Column:
        byte = lambda i, j: F.ascii(F.substr(F.get(p["planes"], i - 1), j, _i(1)).cast("string")) - 48
        along = lambda i, j: (byte(i, j) / 3).cast(INT) % 3 - 1
        down = lambda i, j: byte(i, j) % 3 - 1
        stays = lambda near, far, first: (near > 0) | ((near == 0) & (first | (far <= 0)))

        def step(s: Column, _: Column) -> Column:
            i, j = s["i"], s["j"]

            def moved(v: Column) -> Column:
                x, y = F.substr(s["longer"], j, _i(1)), F.substr(s["shorter"], i, _i(1))
                row_stays = (j > 1) & F.coalesce(stays(along(i, j - 1), along(i, j - 2), j == 2), F.lit(False))
                col_stays = (i > 1) & F.coalesce(stays(down(i - 1, j), down(i - 2, j), i == 2), F.lit(False))
                op = F.when(v == 1, F.when(x == y, F.lit("=")).otherwise("X")).when((v == 0) == s["swapped"], F.lit("I")).otherwise("D")
                return F.struct(
                    F.when(v == 0, i).otherwise(i - 1).alias("i"),
                    F.when(v == 2, j).otherwise(j - 1).alias("j"),
                    F.when((v == 0) & row_stays, _i(0)).when((v == 2) & col_stays, _i(2)).otherwise(_i(-1)).alias("forced"),
                    F.concat(F.when(v == 2, F.lit("-")).otherwise(x), s["top"]).alias("top"),
                    F.concat(F.when(v == 0, F.lit("-")).otherwise(y), s["side"]).alias("side"),
                    F.concat(op, s["ops"]).alias("ops"),
                    s["longer"].alias("longer"),
                    s["shorter"].alias("shorter"),
                    s["swapped"].alias("swapped"),
                )

            way = F.when(s["forced"] >= 0, s["forced"]).otherwise((byte(i, j) / 9).cast(INT))
            return F.when((i > 0) & (j > 0), _let(way, moved)).otherwise(s)

        none = F.lit("")
        start = F.struct(n.alias("i"), m.alias("j"), _i(-1).alias("forced"), none.alias("top"), none.alias("side"), none.alias("ops"), longer.alias("longer"), shorter.alias("shorter"), swapped.alias("swapped"))

        def whole(s: Column) -> Column:
            gap = lambda k: F.repeat(F.lit("-"), k)
            top = F.concat(F.left(s["longer"], s["j"]), gap(s["i"]), s["top"])
            side = F.concat(gap(s["j"]), F.left(s["shorter"], s["i"]), s["side"])
            ops = F.concat(F.repeat(F.when(s["swapped"], F.lit("I")).otherwise("D"), s["j"]), F.repeat(F.when(s["swapped"], F.lit("D")).otherwise("I"), s["i"]), s["ops"])
            rows = [F.when(s["swapped"], x).otherwise(y) for x, y in ((side, top), (top, side))]
            return F.struct(p["total"].cast("bigint").alias("global_score"), p["best"].cast("bigint").alias("max_cell_score"), s["swapped"].alias("swapped"), rows[0].alias("row_a"), rows[1].alias("row_b"), ops.alias("ops"))

        return F.aggregate(positions(n + m), start, step, whole)

    return F.when(a.isNotNull() & b.isNotNull(), _let(_planes(longer, shorter, scheme), walked))


def edit_score(a: Column, b: Column) -> Column:
    """The global score where a match costs nothing and all else 1."""
    return -F.levenshtein(a, b).cast("bigint")


def upper_bound(a: Column, b: Column, scheme: ScoringScheme = DEFAULT) -> Column:
    """No alignment scores more: a cheap filter before the real score, on lengths alone."""
    if scheme.gap_extend > 0:
        return F.lit(1 << 62)
    n, m = F.char_length(a), F.char_length(b)
    gap = F.when(n == m, 0).otherwise(F.abs(n - m) * scheme.gap_extend + scheme.gap_open)
    return (F.least(n, m) * max(scheme.match, scheme.mismatch, 2 * scheme.gap_extend) + gap).cast("bigint")


def padded_length(n: Column, block: int = DEFAULT_BLOCK) -> Column:
    return (F.ceil(n / block) * block).cast("bigint")


def is_swapped(a: Column, b: Column) -> Column:
    """Whether the second is strictly longer and goes first."""
    return F.char_length(b) > F.char_length(a)


def wavefront(n: Column, m: Column, block: int) -> Column:
    """array of (diagonal, tiles): how many tiles of block x block cells can run at once on each anti-diagonal."""
    r, c = F.greatest(F.ceil(n / block), F.lit(1)), F.greatest(F.ceil(m / block), F.lit(1))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), (r + c - 2).cast("bigint")), lambda d: F.struct(d.alias("diagonal"), F.least(d + 1, r, c, r + c - 1 - d).cast("bigint").alias("tiles")))


def wrapped(sequence: Column, width: int) -> Column:
    """Lines of width characters; one line for width 0. One pass over the string, where substr() would start anew for each line."""
    if width <= 0:
        return F.array(sequence)
    return F.when(sequence == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(sequence, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)))


def header_name(header: Column) -> Column:
    return F.split_part(F.regexp_replace(header, "[\r\t]", ""), F.lit(" "), F.lit(1))


def header_comment(header: Column) -> Column:
    clean = F.regexp_replace(header, "[\r\t]", "")
    return F.when(F.instr(clean, " ") > 0, F.substr(clean, F.instr(clean, " ") + 1)).otherwise(F.lit(""))


def guessed_format(text: Column) -> Column:
    """fasta or fastq by which of > and @ comes first, unknown without either."""
    fa, fq = F.instr(text, ">"), F.instr(text, "@")
    return F.when((fa == 0) & (fq == 0), "unknown").when((fq == 0) | ((fa > 0) & (fa < fq)), "fasta").otherwise("fastq")


def folded(sequence: Column, case: str = "original") -> Column:
    """Letters in upper or lower case, or as they are; nothing else changes."""
    if case not in ("upper", "lower", "original"):
        raise ValueError("case must be upper, lower or original")
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return sequence if case == "original" else F.translate(sequence, *((low, up) if case == "upper" else (up, low)))


def dna(text: Column) -> Column:
    """A nucleotide string from a text: a-z become A, C, G, T in turn, the rest goes."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), letters, "".join("ACGT"[i % 4] for i in range(26)))
