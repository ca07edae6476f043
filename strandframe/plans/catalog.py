"""Queries over the test tables, one for each operator, each over its whole tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hof
from ..functions import sql as sql_functions
from ..operators import halving, heaviest, multiple, pairwise, qgram, wavefront
from ..scheme import DEFAULT, DEFAULT_BLOCK, ScoringScheme
from ..sources import datasource, files
from ..streaming import files as stream_files
from ..streaming import incremental as stream
from . import oracle

LINEAR = ScoringScheme(2, -5, -2, 0)
EDIT = ScoringScheme(0, -1, -1, 0)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return note


def expose(spark: SparkSession) -> SparkSession:
    """Let Python workers that share the driver's file system import this package; ship it with --py-files elsewhere."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return expose(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with every region: two dimension tables of fixed size."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k1"), F.col("n_name").alias("a"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("k2"), F.col("r_name").alias("b"))
    return n.crossJoin(r)


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each two distinct part names once, as scores are symmetric."""
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    return pairwise.all_pairs(p, "p_name").select(F.col("x.p_name").alias("k1"), F.col("y.p_name").alias("k2"), F.col("x.p_name").alias("a"), F.col("y.p_name").alias("b"))


def dna_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text, as nucleotides, with the next one: an equi-join."""
    b = table(spark, sf_dir, "benchmark").select("item_id", hof.dna(F.col("text")).alias("s"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("b"))
    return b.join(nxt, "item_id").select("item_id", F.col("s").alias("a"), "b")


_SCORED = "SELECT k1, k2, global_score FROM scored"
_NEXT = f"x AS (SELECT item_id, {oracle.DNA} AS s FROM benchmark), adj AS (SELECT x.item_id, x.s AS a, y.s AS b FROM x JOIN x y ON y.item_id = x.item_id + 1)"


# pairwise scores -----------------------------------------------------------------------------------------------------


@_query(f"WITH RECURSIVE {oracle.dp(oracle.NAMES)} {_SCORED}")
def nw_affine_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.score_pairs(name_pairs(spark, sf_dir), method="catalyst").select("k1", "k2", "global_score")


@_query(f"WITH RECURSIVE {oracle.dp(oracle.NAMES)} SELECT k1, k2, max_cell_score FROM scored")
def nw_max_cell_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.score_pairs(name_pairs(spark, sf_dir), method="catalyst").select("k1", "k2", "max_cell_score")


@_query(f"SELECT k1, k2, -levenshtein(a, b)::BIGINT AS global_score FROM ({oracle.NAMES})")
def nw_linear_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.score_pairs(name_pairs(spark, sf_dir), scheme=EDIT, method="edit").select("k1", "k2", "global_score")


@_query(f"WITH RECURSIVE {oracle.dp(oracle.PARTS)} SELECT k1, k2, global_score, max_cell_score FROM scored")
def nw_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.score_pairs(part_pairs(spark, sf_dir)).select("k1", "k2", "global_score", "max_cell_score")


@_query(f"WITH RECURSIVE {oracle.dp(oracle.PARTS)} {_SCORED}")
def nw_banded_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores within bands that are widened until they are proven."""
    return pairwise.score_pairs(part_pairs(spark, sf_dir), method="banded").select("k1", "k2", "global_score")


@_query(f"WITH RECURSIVE {oracle.dp(oracle.PARTS, LINEAR)} {_SCORED}")
def nw_score_linear_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.score_pairs(part_pairs(spark, sf_dir), scheme=LINEAR).select("k1", "k2", "global_score")


_ITEM_PAIRS = f"SELECT x.item_id AS k1, x.s AS a, y.s AS b FROM (SELECT item_id, {oracle.DNA} AS s FROM benchmark) x JOIN (SELECT item_id, {oracle.DNA} AS s FROM benchmark) y ON y.item_id = x.item_id + 1"


@_query(f"WITH RECURSIVE {oracle.dp_cells(_ITEM_PAIRS)} SELECT k1 AS item_id, global_score, max_cell_score FROM scored")
def nw_dna_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.score_pairs(dna_pairs(spark, sf_dir)).select("item_id", "global_score", "max_cell_score")


@_query(f"WITH RECURSIVE {oracle.dp(oracle.PARTS)} {_SCORED} WHERE global_score >= 0")
def nw_score_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.score_pairs(part_pairs(spark, sf_dir), at_least=0).select("k1", "k2", "global_score")


@_query(f"WITH RECURSIVE {oracle.dp(oracle.PARTS)} SELECT k1, k2, global_score, max_cell_score FROM scored WHERE global_score >= 8")
def score_join_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that score 8 with each other, by their q-grams."""
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    return qgram.score_join(p, "p_name", "p_name", 8).select(F.col("x.p_name").alias("k1"), F.col("y.p_name").alias("k2"), "global_score", "max_cell_score")


_SUPPLIERS = "SELECT x.s_name AS k1, y.s_name AS k2, x.s_name AS a, y.s_name AS b FROM supplier x JOIN supplier y ON x.s_name < y.s_name"


@_query(f"WITH RECURSIVE {oracle.dp(_SUPPLIERS)} {_SCORED} WHERE global_score >= 29")
def score_join_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of suppliers that differ in one symbol; they share most of their q-grams, so that rare ones decide."""
    p = table(spark, sf_dir, "supplier").select("s_name")
    return qgram.score_join(p, "s_name", "s_name", 29, q=4).select(F.col("x.s_name").alias("k1"), F.col("y.s_name").alias("k2"), "global_score")


@_query(f"WITH RECURSIVE {oracle.dp(oracle.NAMES)} SELECT k1, k2, global_score, row_number() OVER (PARTITION BY k1 ORDER BY global_score DESC, k2)::BIGINT AS rank FROM scored QUALIFY rank <= 2")
def best_match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.best_matches(pairwise.score_pairs(name_pairs(spark, sf_dir), method="catalyst"), "k1", 2, ["k2"]).select("k1", "k2", "global_score", "rank")


@_query(f"WITH RECURSIVE {oracle.dp(oracle.PARTS)} SELECT global_score, count(*) AS n FROM scored GROUP BY global_score")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.score_pairs(part_pairs(spark, sf_dir)).groupBy("global_score").agg(F.count(F.lit(1)).alias("n"))


# planning and boundaries ---------------------------------------------------------------------------------------------


@_query(f"WITH {_NEXT} SELECT item_id, length(b) > length(a) AS swapped, greatest(length(a), length(b))::BIGINT AS n_columns, least(length(a), length(b))::BIGINT AS n_rows FROM adj")
def pair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = F.char_length("a"), F.char_length("b")
    return dna_pairs(spark, sf_dir).select("item_id", hof.is_swapped(F.col("a"), F.col("b")).alias("swapped"), F.greatest(n, m).cast("bigint").alias("n_columns"), F.least(n, m).cast("bigint").alias("n_rows"))


@_query(f"SELECT doc_id, (ceil(length(coalesce(text, '')) / {DEFAULT_BLOCK}.0) * {DEFAULT_BLOCK})::BIGINT AS padded FROM documents")
def pad_to_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hof.padded_length(F.char_length(F.coalesce("text", F.lit("")))).alias("padded"))


@_query(f"""WITH {_NEXT}, t AS (SELECT item_id, greatest(1, ceil(length(a) / 64.0))::BIGINT AS r, greatest(1, ceil(length(b) / 64.0))::BIGINT AS c FROM adj)
SELECT item_id, d AS diagonal, least(d + 1, r, c, r + c - 1 - d)::BIGINT AS tiles FROM (SELECT *, unnest(generate_series(0, r + c - 2)) AS d FROM t)""")
def wavefront_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dna_pairs(spark, sf_dir).select("item_id", F.explode(hof.wavefront(F.char_length("a"), F.char_length("b"), 64)).alias("w"))
    return d.select("item_id", "w.diagonal", "w.tiles")


@_query("SELECT item_id, j, (CASE WHEN j = 0 THEN 0 ELSE -4 - 2 * j END)::BIGINT AS score FROM (SELECT item_id, unnest(generate_series(0, length(text))) AS j FROM benchmark)")
def boundary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(hof.boundary_row(F.char_length("text"))).alias("j", "score"))
    return b.select("item_id", F.col("j").cast("bigint").alias("j"), F.col("score").cast("bigint").alias("score"))


@_query(f"""SELECT k1, k2, j, count(*) FILTER (a[j] = c) AS matches, sum(CASE WHEN a[j] = c THEN 2 ELSE -5 END)::BIGINT AS total FROM (
SELECT k1, k2, a, unnest(generate_series(1, length(a))) AS j, b FROM ({oracle.NAMES})), LATERAL (SELECT unnest(string_split(b, '')) AS c) GROUP BY k1, k2, j""")
def substitution_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each column of the first string, its scores against all symbols of the second."""
    d = name_pairs(spark, sf_dir).withColumn("c", F.explode(hof.symbols(F.col("b"))))
    d = d.select("k1", "k2", F.posexplode(hof.substitution_mask(F.col("a"), F.col("c"))).alias("j", "s")).groupBy("k1", "k2", (F.col("j") + 1).cast("bigint").alias("j"))
    return d.agg(F.count_if(F.col("s") == DEFAULT.match).alias("matches"), F.sum("s").alias("total"))


@_query("""SELECT item_id, j, max(v + 2 * j) OVER (PARTITION BY item_id ORDER BY j ROWS UNBOUNDED PRECEDING) - 2 * j AS best FROM (
SELECT item_id, j, unicode(text[j])::BIGINT AS v FROM (SELECT item_id, text, unnest(generate_series(1, length(text))) AS j FROM benchmark))""")
def prefix_max_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a value carried along with 2 off for each step: a running maximum of value and position together."""
    d = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(hof.symbols(F.col("text"))).alias("p", "c"))
    d = d.select("item_id", (F.col("p") + 1).cast("bigint").alias("j"), F.ascii("c").cast("bigint").alias("v"))
    w = W.partitionBy("item_id").orderBy("j").rowsBetween(W.unboundedPreceding, W.currentRow)
    return d.select("item_id", "j", (F.max(F.col("v") + 2 * F.col("j")).over(w) - 2 * F.col("j")).alias("best"))


# traceback -----------------------------------------------------------------------------------------------------------


@_query(f"WITH RECURSIVE {oracle.trace(oracle.NAMES)} SELECT k1, k2, swapped, row_a, row_b, ops FROM traced")
def nw_traceback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.align_pairs(name_pairs(spark, sf_dir)).select("k1", "k2", "swapped", "row_a", "row_b", "ops")


@_query(f"WITH RECURSIVE {oracle.trace(oracle.PARTS, LINEAR)} SELECT k1, k2, row_a, row_b FROM traced")
def nw_traceback_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.align_pairs(part_pairs(spark, sf_dir), scheme=LINEAR).select("k1", "k2", "row_a", "row_b")


@_query(f"WITH RECURSIVE {oracle.trace(oracle.NAMES)} SELECT k1, k2, swapped, row_a, row_b, ops, global_score FROM traced")
def traceback_in_catalyst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, rows and operations without a Python process."""
    return pairwise.align_pairs(name_pairs(spark, sf_dir), method="catalyst").select("k1", "k2", "swapped", "row_a", "row_b", "ops", "global_score")


@_query(f"WITH RECURSIVE {oracle.trace(oracle.PARTS, LINEAR)} SELECT k1, k2, row_a, row_b, global_score FROM traced")
def traceback_in_catalyst_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.align_pairs(part_pairs(spark, sf_dir), scheme=LINEAR, method="catalyst").select("k1", "k2", "row_a", "row_b", "global_score")


@_query(f"SELECT k1, k2, a, b FROM ({oracle.NAMES})")
def traceback_degap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairwise.align_pairs(name_pairs(spark, sf_dir))
    return d.select("k1", "k2", F.translate("row_a", "-", "").alias("a"), F.translate("row_b", "-", "").alias("b"))


@_query(f"WITH RECURSIVE {oracle.dp(oracle.PARTS)} {_SCORED}")
def traceback_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairwise.align_pairs(part_pairs(spark, sf_dir))
    return d.select("k1", "k2", pairwise.rescored(F.col("ops")).alias("global_score"))


@_query(f"""WITH RECURSIVE {oracle.trace(oracle.NAMES)} SELECT k1, k2, count(*) FILTER (c = '=') AS matches, count(*) FILTER (c = 'X') AS mismatches,
count(*) FILTER (c IN ('I', 'D')) AS gaps FROM (SELECT k1, k2, unnest(string_split(ops, '')) AS c FROM traced) GROUP BY k1, k2""")
def alignment_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairwise.alignment_columns(pairwise.align_pairs(name_pairs(spark, sf_dir)), ["k1", "k2"]).groupBy("k1", "k2")
    return d.agg(F.count_if(F.col("op") == "=").alias("matches"), F.count_if(F.col("op") == "X").alias("mismatches"), F.count_if(F.col("op").isin("I", "D")).alias("gaps"))


@_query(f"WITH RECURSIVE {oracle.trace(oracle.NAMES)} SELECT k1, k2, '>1' || chr(10) || (CASE WHEN swapped THEN row_b ELSE row_a END) || chr(10) || '>2' || chr(10) || (CASE WHEN swapped THEN row_a ELSE row_b END) AS record FROM traced")
def pair_sink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.align_pairs(name_pairs(spark, sf_dir)).select("k1", "k2", files.pair_text().alias("record"))


@_query()
def nw_dna_traceback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.align_pairs(dna_pairs(spark, sf_dir)).select("item_id", "global_score", "max_cell_score", "swapped", "row_a", "row_b", "ops")


@_query(f"WITH RECURSIVE {oracle.dp_cells(_ITEM_PAIRS)} SELECT k1 AS item_id, global_score, length(a)::BIGINT AS symbols_a, length(b)::BIGINT AS symbols_b FROM scored JOIN pairs USING (k1)")
def halved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of texts in linear space, cut into pieces of 5,000 cells; the score is worked out from their operations."""
    d = halving.align_long(dna_pairs(spark, sf_dir), "item_id", _folder(spark, "halved_pairs"), cells=5000)
    symbols = lambda other: F.char_length(F.translate("ops", other, "")).cast("bigint")
    return d.select("item_id", "global_score", symbols("I").alias("symbols_a"), symbols("D").alias("symbols_b"))


_DNA_NAMES = f"SELECT k1, k2, {oracle.DNA.replace('text', 'a')} AS a, {oracle.DNA.replace('text', 'b')} AS b FROM ({oracle.NAMES})"


def dna_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole names as nucleotides, short enough for SQL to score; texts are nw_dna_score's."""
    return name_pairs(spark, sf_dir).withColumns({c: hof.dna(F.col(c)) for c in "ab"})


@_query(f"WITH RECURSIVE {oracle.dp(_DNA_NAMES)} SELECT k1, k2, global_score, max_cell_score FROM scored")
def nw_dna_name_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.score_pairs(dna_name_pairs(spark, sf_dir)).select("k1", "k2", "global_score", "max_cell_score")


@_query(f"WITH RECURSIVE {oracle.trace(_DNA_NAMES)} SELECT k1, k2, swapped, row_a, row_b, ops FROM traced")
def nw_dna_name_traceback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.align_pairs(dna_name_pairs(spark, sf_dir)).select("k1", "k2", "swapped", "row_a", "row_b", "ops")


@_query(f"WITH RECURSIVE {oracle.dp(oracle.NAMES)} SELECT k1, k2, global_score, max_cell_score FROM scored")
def sql_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions in SQL text."""
    sql_functions.register(expose(spark))
    return spark.sql("SELECT k1, k2, nw_score(a, b) AS global_score, nw_max_cell(a, b) AS max_cell_score FROM {pairs}", pairs=name_pairs(spark, sf_dir))


@_query(f"""WITH RECURSIVE {oracle.trace(oracle.NAMES)} SELECT k1, k2, i::INT AS "column", row_a[i] AS symbol_a, row_b[i] AS symbol_b, ops[i] AS op
FROM (SELECT *, unnest(generate_series(1, length(ops))) AS i FROM traced)""")
def sql_alignment_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment function and a table function over its result, in SQL text."""
    sql_functions.register(expose(spark))
    aligned = spark.sql("SELECT k1, k2, nw_align(a, b) AS x FROM {pairs}", pairs=name_pairs(spark, sf_dir))
    return spark.sql("SELECT k1, k2, c.* FROM {aligned}, LATERAL alignment_columns(x.row_a, x.row_b, x.ops) AS c", aligned=aligned)


_LONG = "SELECT 0 AS k1, 0 AS k2, (SELECT string_agg(n_name, '' ORDER BY n_name) FROM nation) AS a, (SELECT string_agg(r_name, '' ORDER BY r_name) FROM region) AS b"


@_query(f"WITH RECURSIVE {oracle.dp(_LONG)} SELECT global_score, max_cell_score FROM scored")
def tiled_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair whose matrix is cut into tiles for many tasks: the names of all nations and of all regions, two tables of fixed size."""
    joined = lambda t, c: "".join(sorted(r[0] for r in table(spark, sf_dir, t).select(c).collect()))
    return spark.createDataFrame([wavefront.score_tiled(spark, joined("nation", "n_name"), joined("region", "r_name"), size=24)], "global_score bigint, max_cell_score bigint")


# files ---------------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A folder for files of this run: under spark.checkpoint.dir if set, else under the warehouse, which executors share too."""
    import uuid

    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item"), F.col("item_id")).alias("name"), F.concat(F.lit("length "), F.char_length("text")).alias("comment"), hof.dna(F.col("text")).alias("sequence"))


@_query(f"SELECT 'item' || item_id AS name, 'length ' || length(text) AS comment, {oracle.DNA} AS sequence FROM benchmark")
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.write_fasta(_items(spark, sf_dir), path := _folder(spark, "fasta"), include_comment=True)
    return files.read_sequences(spark, path, "fasta").select("name", "comment", "sequence")


@_query(f"SELECT 'item' || item_id AS name, 'length ' || length(text) AS comment, upper({oracle.DNA}) AS sequence FROM benchmark")
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.write_fasta(_items(spark, sf_dir), path := _folder(spark, "fasta"), include_comment=True, case="upper", line_width=60)
    return files.scan_fasta(spark, path)


@_query(f"SELECT 'item' || item_id AS name, 'length ' || length(text) AS comment, lower({oracle.DNA}) AS sequence FROM benchmark")
def fasta_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read by format("fasta"), in gzip files."""
    datasource.register(expose(spark))
    items = _items(spark, sf_dir).select("name", "comment", "sequence")
    items.write.format("fasta").mode("append").options(includeComment="true", baseCase="lower", gzip="true").save(path := _folder(spark, "format"))
    return spark.read.format("fasta").load(path).select("name", "comment", "sequence")


@_query(f"SELECT 'item' || item_id AS name, {oracle.DNA} AS sequence, repeat('@', length({oracle.DNA})) AS quality FROM benchmark")
def fastq_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by format("fastq") and read by format("seqfile"), which tells the kind of file by itself."""
    datasource.register(expose(spark))
    items = _items(spark, sf_dir).select("name", "sequence", F.repeat(F.lit("@"), F.char_length("sequence")).alias("quality"))
    items.write.format("fastq").mode("append").save(path := _folder(spark, "format"))
    return spark.read.format("seqfile").load(path).select("name", "sequence", "quality")


@_query("SELECT 'doc' || doc_id AS name, lang AS comment, length(text)::BIGINT AS symbols FROM documents WHERE ends_with('doc' || doc_id, '7') AND lang = 'en'")
def seqfile_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as FASTA records, of which a filter on names and comments is pushed into the reader."""
    datasource.register(expose(spark))
    text = F.regexp_replace("text", "[\n\r>]", "_")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id")).alias("name"), F.col("lang").alias("comment"), text.alias("sequence"))
    files.write_fasta(d, path := _folder(spark, "fasta"), include_comment=True)
    found = spark.read.format("seqfile").load(path).where(F.endswith("name", F.lit("7")) & (F.col("comment") == "en") & (F.col("format") == "fasta"))
    return found.select("name", "comment", F.char_length("sequence").cast("bigint").alias("symbols"))


@_query(f"SELECT 'item' || item_id AS name, lower({oracle.DNA}) AS sequence, repeat('@', length({oracle.DNA})) AS quality FROM benchmark")
def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip files whose quality lines all begin with the mark of a record."""
    items = _items(spark, sf_dir).withColumn("quality", F.repeat(F.lit("@"), F.char_length("sequence")))
    files.write_fastq(items, path := _folder(spark, "fastq"), case="lower", compression="gzip")
    return files.read_sequences(spark, path).select("name", "sequence", "quality")


@_query("SELECT 'doc' || doc_id AS name, source AS comment, regexp_replace(coalesce(text, ''), '[\n\r+]', '_', 'g') AS sequence, repeat('@', length(coalesce(text, ''))) AS quality FROM documents")
def fastq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as sequences, in plain files that are split among tasks; all qualities begin with the mark of a record."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[\n\r+]", "_")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id")).alias("name"), F.col("source").alias("comment"), text.alias("sequence"), F.repeat(F.lit("@"), F.char_length(text)).alias("quality"))
    files.write_fastq(d, path := _folder(spark, "fastq"), include_comment=True)
    return files.scan_fastq(spark, path).select("name", "comment", "sequence", "quality")


@_query("""SELECT doc_id, i::BIGINT AS line, substr(text, i * 80 + 1, 80) AS part FROM (
SELECT doc_id, coalesce(text, '') AS text, unnest(generate_series(0, greatest(1, ceil(length(coalesce(text, '')) / 80.0))::BIGINT - 1)) AS i FROM documents)""")
def fasta_wrap80(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(hof.wrapped(F.coalesce("text", F.lit("")), 80)).alias("line", "part"))
    return d.withColumn("line", F.col("line").cast("bigint"))


@_query("""SELECT DISTINCT h AS header, split_part(h, ' ', 1) AS name, CASE WHEN instr(h, ' ') > 0 THEN substr(h, instr(h, ' ') + 1) ELSE '' END AS comment
FROM (SELECT p_name || ' ' || p_type AS h FROM part UNION ALL SELECT p_name FROM part)""")
def header_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    h = p.select(F.concat_ws(" ", "p_name", "p_type").alias("header")).union(p.select("p_name")).distinct()
    return h.select("header", hof.header_name(F.col("header")).alias("name"), hof.header_comment(F.col("header")).alias("comment"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ZA = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


@_query(f"SELECT item_id, translate(text, {_ZA}) AS upper, translate(text, {_AZ}) AS lower FROM benchmark")
def case_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", hof.folded(F.col("text"), "upper").alias("upper"), hof.folded(F.col("text"), "lower").alias("lower"))


@_query("""SELECT page_id, CASE WHEN instr(html, '>') = 0 AND instr(html, '@') = 0 THEN 'unknown'
WHEN instr(html, '@') = 0 OR (instr(html, '>') > 0 AND instr(html, '>') < instr(html, '@')) THEN 'fasta' ELSE 'fastq' END AS format FROM pages""")
def format_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", hof.guessed_format(F.col("html")).alias("format"))


@_query("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS total, max(length(text))::BIGINT AS longest FROM documents GROUP BY lang")
def seq_count_and_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"), F.max(n).cast("bigint").alias("longest"))


@_query(f"SELECT lang, base, sum(n)::BIGINT AS n FROM (SELECT lang, base, length(s) - length(replace(s, base, '')) AS n FROM (SELECT lang, {oracle.DNA} AS s FROM documents), (SELECT unnest(['A', 'C', 'G', 'T']) AS base)) GROUP BY lang, base")
def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted in each row by removing the base, so only four numbers a language are shuffled by each task."""
    d = table(spark, sf_dir, "documents").select("lang", hof.dna(F.col("text")).alias("s"))
    count = lambda c: F.sum(F.octet_length("s") - F.octet_length(F.replace("s", F.lit(c), F.lit(""))))
    wide = d.groupBy("lang").agg(*(count(c).alias(c) for c in "ACGT"))
    return wide.select("lang", F.explode(F.array(*(F.struct(F.lit(c).alias("base"), F.col(c).alias("n")) for c in "ACGT"))).alias("x")).select("lang", "x.base", "x.n")


# partial-order graphs ------------------------------------------------------------------------------------------------


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct()


_POINTS = "SELECT p_name, unnest(generate_series(0, length(p_name) - 1)) AS node_id FROM (SELECT DISTINCT p_name FROM part)"


@_query(f"SELECT p_name, node_id::INT AS node_id, p_name[node_id + 1] AS base FROM ({_POINTS})")
def poa_init_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.seed_nodes(_names(spark, sf_dir), "p_name", "p_name")


@_query(f"SELECT p_name, (node_id - 1)::INT AS src, node_id::INT AS dst, 1 AS weight FROM ({_POINTS}) WHERE node_id > 0")
def poa_init_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.seed_edges(_names(spark, sf_dir), "p_name", "p_name")


@_query("SELECT DISTINCT p_name, 1::BIGINT AS sinks FROM part")
def poa_sink_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _names(spark, sf_dir)
    s = multiple.sinks(multiple.seed_nodes(d, "p_name", "p_name"), multiple.seed_edges(d, "p_name", "p_name"), "p_name")
    return s.groupBy("p_name").agg(F.count(F.lit(1)).alias("sinks"))


_BRANDS = "SELECT DISTINCT p_brand AS set_id, p_name AS s FROM part"


def _brand_sets(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The distinct part names of each brand, in the order of the names."""
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("set_id"), F.col("p_name").alias("s")).distinct()
    return multiple.progressive(d, order="s", sequence="s", name="s", fields=fields)


@_query(f"SELECT set_id, sum(length(s) - 1)::BIGINT AS weight FROM ({_BRANDS}) GROUP BY set_id")
def poa_edge_weight_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.graph_edges(_brand_sets(spark, sf_dir, "edges")).groupBy("set_id").agg(F.sum("weight").alias("weight"))


@_query(f"WITH RECURSIVE {oracle.dp(oracle.NAMES)} SELECT k1 * 100 + k2 AS set_id, global_score AS end_score FROM scored")
def poa_two_seq_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of a second sequence against the graph of the first is their pairwise score."""
    return multiple.rounds(_pair_sets(spark, sf_dir, "rounds")).select("set_id", "end_score")


def _pair_sets(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Each nation with each region as a set of two sequences."""
    p = name_pairs(spark, sf_dir).withColumn("set_id", F.col("k1") * 100 + F.col("k2"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("seq_idx"), F.col("a").alias("sequence")), F.struct(F.lit(1).alias("seq_idx"), F.col("b").alias("sequence"))))
    return multiple.progressive(p.select("set_id", both.alias("x")).select("set_id", "x.*"), fields=fields)


_PAIR_MSA = f"WITH RECURSIVE {oracle.pair_msa(oracle.NAMES)}"


@_query(f"{_PAIR_MSA} SELECT k1 * 100 + k2 AS set_id, i::INT AS seq_idx, CASE WHEN i = 0 THEN row_a ELSE row_b END AS row FROM msa, (SELECT unnest([0, 1]) AS i)")
def msa_rows_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.msa_rows(_pair_sets(spark, sf_dir, "rows")).select("set_id", "seq_idx", "row")


@_query(f"{_PAIR_MSA} SELECT k1 * 100 + k2 AS set_id, consensus FROM consensus")
def msa_consensus_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.msa_consensus(_pair_sets(spark, sf_dir, "consensus"))


@_query(f"""{_PAIR_MSA} SELECT k1 * 100 + k2 AS set_id, '>1' || chr(10) || row_a || chr(10) || '>2' || chr(10) || row_b || chr(10) || 'consensus:' || chr(10) || consensus AS record
FROM msa JOIN consensus USING (k1, k2)""")
def msa_sink_text_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_sets(spark, sf_dir, "rows", "consensus").select("set_id", files.msa_text().alias("record"))


@_query(f"""{_PAIR_MSA}, g AS (SELECT k1 * 100 + k2 AS set_id, count(*)::INT AS nodes, count(*) FILTER (op IN ('I', 'X'))::INT AS nodes_added, max(length(a))::INT AS nodes_before FROM placed GROUP BY ALL),
s AS (WITH RECURSIVE {oracle.dp(oracle.NAMES)} SELECT k1 * 100 + k2 AS set_id, global_score AS end_score FROM scored)
SELECT set_id, 1 AS round, nodes_before, end_score, nodes_added FROM g JOIN s USING (set_id)""")
def poa_rounds_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.rounds(_pair_sets(spark, sf_dir, "rounds"))


@_query(f"""{_PAIR_MSA}, n AS (SELECT k1 * 100 + k2 AS set_id, dense_rank() OVER (PARTITION BY k1, k2 ORDER BY k, phase, CASE WHEN op IN ('=', 'X') THEN 0 ELSE t END) - 1 AS col,
  CASE op WHEN '=' THEN [struct_pack(base := a[ia], seq_ids := [0, 1])] WHEN 'X' THEN [struct_pack(base := a[ia], seq_ids := [0]), struct_pack(base := b[ib], seq_ids := [1])]
  WHEN 'D' THEN [struct_pack(base := a[ia], seq_ids := [0])] ELSE [struct_pack(base := b[ib], seq_ids := [1])] END AS own FROM ordered)
SELECT set_id, col::INT AS "column", x.base AS base, array_to_string(x.seq_ids, ',') AS seq_ids FROM (SELECT set_id, col, unnest(own) AS x FROM n)""")
def poa_nodes_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.graph_nodes(_pair_sets(spark, sf_dir, "nodes")).select("set_id", "column", "base", F.array_join("seq_ids", ",").alias("seq_ids"))


_NO_GAPS = ScoringScheme(2, -1, -100, -127)
_EQUAL = "q AS (SELECT s_nationkey::BIGINT AS set_id, s_suppkey AS seq_idx, s_name AS s FROM supplier)"


def _equal_sets(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The suppliers of each nation: whole names, all of 18 symbols, with gaps so dear that none is made."""
    d = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("set_id"), F.col("s_suppkey").alias("seq_idx"), F.col("s_name").alias("sequence"))
    return multiple.progressive(d, scheme=_NO_GAPS, fields=fields)


#: Two gaps cost more than 511 symbols can gain; texts have 326 at most.
_NO_GAPS_IN_TEXTS = ScoringScheme(1, 0, -128, -128)
_FILLED = f"""x AS (SELECT -1 - item_id // 5 AS set_id, item_id % 5 AS seq_idx, {oracle.DNA} AS s FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT s_nationkey::BIGINT AS set_id, s_suppkey AS seq_idx, s_name AS s, 2 AS hit, -1 AS miss FROM supplier
  UNION ALL SELECT set_id, seq_idx, rpad(s, (max(length(s)) OVER (PARTITION BY set_id))::INT, 'N'), 1, 0 FROM x)"""


def _filled_sets(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """All benchmark texts as nucleotides, whole, five a set: to the end of the set's longest each is filled with N."""
    d = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select((-1 - F.expr("item_id div 5")).cast("bigint").alias("set_id"), (F.col("item_id") % 5).alias("seq_idx"), hof.dna(F.col("text")).alias("s"))
    longest = F.max(F.char_length("s")).over(W.partitionBy("set_id"))
    return multiple.progressive(d.select("set_id", "seq_idx", F.rpad("s", longest, F.lit("N")).alias("sequence")), scheme=_NO_GAPS_IN_TEXTS, fields=fields)


@_query(f"""WITH RECURSIVE {_FILLED},
c AS (SELECT set_id, seq_idx, j::INT AS j, s[j] AS now, s[j - 1] AS was, hit, miss FROM (SELECT *, unnest(generate_series(1, length(s))) AS j FROM q)),
e AS (SELECT DISTINCT t.set_id, t.seq_idx, t.j, p.was, p.now, CASE WHEN p.now = t.now THEN t.hit ELSE t.miss END AS gain FROM c t JOIN c p ON p.set_id = t.set_id AND p.j = t.j AND p.seq_idx < t.seq_idx),
best AS (SELECT set_id, seq_idx, j, now, max(gain)::BIGINT AS score FROM e WHERE j = 1 GROUP BY ALL
  UNION ALL SELECT e.set_id, e.seq_idx, e.j, e.now, max(best.score + e.gain)::BIGINT FROM best JOIN e ON e.set_id = best.set_id AND e.seq_idx = best.seq_idx AND e.j = best.j + 1 AND e.was = best.now GROUP BY ALL),
ranked AS (SELECT set_id, seq_idx, row_number() OVER (PARTITION BY set_id ORDER BY seq_idx) - 1 AS round FROM q),
nodes AS (SELECT q.set_id, q.seq_idx, (SELECT count(*) FROM (SELECT DISTINCT c.j, c.now FROM c WHERE c.set_id = q.set_id AND c.seq_idx < q.seq_idx))::INT AS nodes_before FROM q)
SELECT set_id, round::INT AS round, nodes_before, max(score) AS end_score FROM best JOIN ranked USING (set_id, seq_idx) JOIN nodes USING (set_id, seq_idx) JOIN q USING (set_id, seq_idx) WHERE j = length(s) GROUP BY ALL""")
def poa_rounds_without_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no gap is made, a sequence's score is that of the best way through the columns along edges of those before it:
    suppliers' names, a set for each nation, and whole benchmark texts, five a set (set_id below 0)."""
    sets = _equal_sets(spark, sf_dir, "rounds").unionByName(_filled_sets(spark, sf_dir, "rounds"))
    return multiple.rounds(sets).select("set_id", "round", "nodes_before", "end_score")


@_query(f"WITH {_EQUAL} SELECT set_id, (row_number() OVER (PARTITION BY set_id ORDER BY seq_idx) - 1)::INT AS seq_idx, s AS row FROM q")
def msa_rows_without_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.msa_rows(_equal_sets(spark, sf_dir, "rows")).select("set_id", "seq_idx", "row")


@_query(f"SELECT set_id, s AS name, s AS sequence FROM ({_BRANDS})")
def msa_degap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.msa_rows(_brand_sets(spark, sf_dir, "rows")).select("set_id", "name", F.translate("row", "-", "").alias("sequence"))


@_query("SELECT DISTINCT p_brand AS set_id, 1::BIGINT AS widths FROM part")
def msa_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.msa_rows(_brand_sets(spark, sf_dir, "rows")).groupBy("set_id").agg(F.count_distinct(F.char_length("row")).alias("widths"))


@_query("SELECT DISTINCT p_name AS set_id, p_name AS consensus FROM part")
def msa_consensus_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus of three copies of a name is the name."""
    d = _names(spark, sf_dir).select(F.col("p_name").alias("set_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq_idx"), F.col("p_name").alias("sequence"))
    return multiple.msa_consensus(multiple.progressive(d))


@_query("SELECT DISTINCT p_name AS set_id, (length(p_name) - 1)::BIGINT AS hp_score, length(p_name)::INT AS hp_len FROM part")
def heaviest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along a chain of weight 1 the last node scores the number of edges."""
    d = _names(spark, sf_dir).select(F.col("p_name").alias("set_id"), F.lit(0).alias("seq_idx"), F.col("p_name").alias("sequence"))
    n = multiple.graph_nodes(multiple.progressive(d))
    return n.groupBy("set_id").agg(F.max("hp_score").alias("hp_score"), F.max("hp_len").alias("hp_len"))


@_query()
def poa_progressive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.rounds(_brand_sets(spark, sf_dir, "rounds"))


@_query()
def poa_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.graph_nodes(_brand_sets(spark, sf_dir, "nodes"))


@_query()
def msa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.msa_rows(_brand_sets(spark, sf_dir, "rows"))


@_query()
def msa_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple.msa_consensus(_brand_sets(spark, sf_dir, "consensus"))


@_query()
def poa_consensus_as_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaviest paths of all brands' graphs by rounds of joins over their nodes and edges."""
    _brand_sets(spark, sf_dir, "nodes", "edges").write.parquet(path := _folder(spark, "sets"))
    sets = spark.read.parquet(path)
    return heaviest.consensus(multiple.graph_nodes(sets), multiple.graph_edges(sets), _folder(spark, "paths"))


@_query(ORACLES["msa_consensus_of_pairs"])
def poa_consensus_of_pairs_as_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    _pair_sets(spark, sf_dir, "nodes", "edges").write.parquet(path := _folder(spark, "sets"))
    sets = spark.read.parquet(path)
    return heaviest.consensus(multiple.graph_nodes(sets), multiple.graph_edges(sets), _folder(spark, "paths"))


_PLACES = "SELECT p_brand AS set_id, i::BIGINT AS i, ascii(s[i + 1])::BIGINT AS c, CASE WHEN i > 0 THEN ascii(s[i])::BIGINT END AS b FROM (SELECT p_brand, s, unnest(generate_series(0, length(s) - 1)) AS i FROM (SELECT DISTINCT p_brand, p_name AS s FROM part))"


@_query(f"""WITH RECURSIVE places AS ({_PLACES}), e AS (SELECT set_id, i, b, c, count(*) AS w FROM places WHERE i > 0 GROUP BY ALL),
best AS (SELECT set_id, 0::BIGINT AS i, c, 0::BIGINT AS score, -1::BIGINT AS pred, 1 AS len FROM places WHERE i = 0 GROUP BY ALL
UNION ALL SELECT set_id, i, c, score, pred, len FROM (
  SELECT e.set_id, e.i, e.c, best.score + e.w AS score, best.i * 128 + e.b AS pred, best.len + 1 AS len,
  row_number() OVER (PARTITION BY e.set_id, e.c ORDER BY e.w DESC, best.score DESC, e.b DESC) AS r FROM best JOIN e ON e.set_id = best.set_id AND e.i = best.i + 1 AND e.b = best.c) WHERE r = 1)
SELECT set_id, i * 128 + c AS node_id, score::BIGINT AS hp_score, pred::INT AS hp_pred, len::INT AS hp_len FROM best""")
def poa_best_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of the part names of each brand, written above each other without gaps: one node for each place and letter,
    which many names leave and enter; the best way to each node."""
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("set_id"), F.col("p_name").alias("s")).distinct()
    at = s.select("set_id", F.posexplode(F.transform(hof.symbols(F.col("s")), lambda c: F.ascii(c).cast("bigint"))).alias("i", "c"), "s")
    node = F.col("i") * 128 + F.col("c")
    before = (F.col("i") - 1) * 128 + F.ascii(F.substring("s", F.col("i"), F.lit(1)))
    nodes = at.select("set_id", node.alias("node_id"), node.alias("topo_idx")).distinct()
    edges = at.where("i > 0").select("set_id", before.alias("src"), node.alias("dst")).groupBy("set_id", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return heaviest.best_ways(nodes, edges.withColumn("pred_ord", F.col("src")), _folder(spark, "paths"))


@_query()
def msa_sink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brand_sets(spark, sf_dir, "rows", "consensus").select("set_id", files.msa_text().alias("record"))


@_query("SELECT 'doc' || doc_id AS name, coalesce(lang, '') AS comment, length(coalesce(text, ''))::BIGINT AS symbols FROM documents")
def streaming_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as FASTA files that a stream reads, 100 at a time, and writes as FASTA files again, one folder a micro-batch."""
    text = F.regexp_replace("text", "[\n\r>]", "_")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id")).alias("name"), F.col("lang").alias("comment"), text.alias("sequence"))
    files.write_fasta(d, path := _folder(spark, "fasta"), include_comment=True)
    out, state = _folder(spark, "epochs"), _folder(spark, "state")
    read = stream_files.stream_sequences(spark, f"{path}/part-*", files_a_batch=100)
    stream_files.write_epochs(read, out, state, files.fasta_text(include_comment=True)).trigger(availableNow=True).start().awaitTermination()
    return files.scan_fasta(spark, f"{out}/epoch=*").select("name", "comment", F.char_length("sequence").cast("bigint").alias("symbols"))


@_query("SELECT n_regionkey::BIGINT AS set_id, count(*)::INT AS n_sequences, sum(length(n_name) - 1)::BIGINT AS weight FROM nation GROUP BY n_regionkey")
def streaming_msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations as a stream, a set for each region: how many joined, and the weight of the edges they left."""
    schema = table(spark, sf_dir, "nation").schema
    names = spark.readStream.schema(schema).option("pathGlobFilter", "nation.parquet").parquet(sf_dir).select(F.col("n_regionkey").cast("bigint").alias("set_id"), F.col("n_nationkey").alias("seq_idx"), F.col("n_name").alias("sequence"))
    folder = _folder(spark, "stream")
    write = stream.incremental(names).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
    write.foreachBatch(lambda batch, i: batch.write.mode("append").parquet(f"{folder}/out")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out").groupBy("set_id").agg(F.max("n_sequences").alias("n_sequences"), F.max_by("weight", "n_sequences").alias("weight"))
    return out.select("set_id", "n_sequences", "weight")
