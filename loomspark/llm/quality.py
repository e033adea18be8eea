"""Quality rules: a table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import free

#: (measure, operator that keeps, threshold). A document is kept if the base rule passes and all these hold.
RULES: list[tuple[str, str, float]] = [
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 12.0),
    ("symbol_ratio", "<=", 0.1),
    ("stop_ratio", ">=", 0.06),
    ("dup_line_ratio", "<=", 0.5),
    ("ellipsis_line_ratio", "<=", 0.3),
    ("upper_ratio", "<=", 0.4),
]
#: Frequent words of the languages that the corpus holds; a document without them is no running text.
STOP_WORDS = (
    "the of and to in is that it with as for was on are by this be at from or an a which you had not but have "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il "
    "el los las y del se por con una su para al lo como más o pero sus"
).split()

SPACES = " \t\n\x0b\x0c\r"


def word_list(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def measures(docs: DataFrame) -> DataFrame:
    """docs plus the measures of the rules; built-in expressions only. Columns that begin with `_` may be replaced.

    Repeated three-word windows are compared by 64-bit hash. Sorting (hash, place) pairs puts equal windows side by
    side; of their places in order, each covers three words or as many as the next one leaves it. Texts whose windows
    all differ, most of them, stop at the distinct count."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.withColumn("_t", t).withColumn("_w", word_list(F.col("_t"))).withColumn("n_words", F.size("_w").cast("long"))
    n = F.col("n_words").cast("int")
    zipped = F.arrays_zip(F.slice("_w", F.lit(1), n - 2).alias("a"), F.slice("_w", F.lit(2), n - 2).alias("b"), F.slice("_w", F.lit(3), n - 2).alias("c"))
    hashes = F.transform(zipped, lambda z: F.xxhash64(z["a"], z["b"], z["c"]))
    d = d.withColumn("_h", F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs))
    m = F.size("_s")
    twins = F.zip_with(F.slice("_s", F.lit(1), m - 1), F.slice("_s", F.lit(2), m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))))
    k = F.size("_p")
    gaps = F.zip_with(F.slice("_p", F.lit(1), k - 1), F.slice("_p", F.lit(2), k - 1), lambda a, b: F.least(b - a, F.lit(3)))
    d = d.withColumn("n_repeat_words", F.when(F.col("_p").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).cast("long"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    d = d.withColumn("_l", lines)
    joined = F.array_join("_w", "")
    d = d.withColumns(
        {
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long"),
            "_n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_n_ellipsis": F.size(F.filter("_l", lambda x: x.endswith("..."))).cast("long"),
            "_n_stop": F.size(F.filter("_w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
            "_n_upper": F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long"),
        }
    )
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.withColumns(
        {
            "mean_word_chars": over("word_chars", "n_words"),
            "symbol_ratio": over("n_symbols", "word_chars"),
            "stop_ratio": over("_n_stop", "n_words"),
            "dup_line_ratio": over("n_dup_lines", "_n_lines"),
            "ellipsis_line_ratio": over("_n_ellipsis", "_n_lines"),
            "upper_ratio": over("_n_upper", "word_chars"),
        }
    )


def compile_rules(rules: list[tuple[str, str, float]] = RULES) -> Column:
    """One boolean column of the threshold table."""
    verdict = F.lit(True)
    for name, op, limit in rules:
        verdict = verdict & (F.col(name) >= limit if op == ">=" else F.col(name) <= limit)
    return verdict


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def assess(docs: DataFrame, rules: list[tuple[str, str, float]] = RULES) -> DataFrame:
    """docs plus counts, ratios, base_failed and kept.

    Null and empty texts have no words: all counts 0, base_failed true, kept false. Columns of docs named like the
    added ones are replaced, all others come back as they are; repeated rows each return a row; an empty table gives an
    empty result. A text is held whole, with its words and their window hashes as arrays of one row."""
    ratios = list(dict.fromkeys(r[0] for r in RULES))
    new = [*COUNTS, *ratios, "base_failed", "kept"]
    keep = [c for c in docs.columns if c not in new]
    row = free(["text"], "row")[0]
    d = measures(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias(row), "text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    d = d.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    return d.select(*[F.col(row)[c].alias(c) for c in keep], *new)
