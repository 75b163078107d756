"""Secret scans of whole texts in DataFrame functions: candidates, and a random forest that removes false ones.

Candidates are runs of ``A-Za-z0-9+/_-`` of 16 characters or more, or of 8 after an assignment. Their features are
length, character transitions (changes between lower case, upper case, digits and marks; shares of each; vowels;
different characters), dictionary coverage (the share that is words which the corpus itself repeats), the path the
text came from, and the words before and after.

The forest learns from labelled findings: ``labelled`` gives a label for some candidates (default ``known_formats``:
issued key formats and assigned random values are secrets; plain words and placeholders are not), of which at most
``train`` of each label, by hash, are used. It scores every candidate; those from ``accept`` on are secrets.

Word counts cover the whole corpus and are aggregated before the shuffle; they are joined, never broadcast by
hint. NULL and empty texts have no candidates. Rows are told apart by id, path and text, repeated rows keep a row
each. Without labels of both kinds every labelled candidate keeps its label and the others score 0.5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairset.llm.common import stored, whole_text

_RUN = "[A-Za-z0-9+/_-]"
_CANDIDATE = rf"(?<!{_RUN})(?:{_RUN}{{16,}}+|(?<=[=:]\s{{0,2}}[\"']?){_RUN}{{8,}}+)"
# Formats of issued keys, words that announce a secret and words that speak against one.
_ISSUED = (
    r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,}|sk_live_[A-Za-z0-9]{16,}|"
    r"xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,})$"
)
_CUE = r"(?i)(?:password|passwd|pwd|secret|token|api.?key|access.?key|auth|bearer|credential)\W{0,4}$"
_PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|fake|1234567|abcdef"
_TEST_PATH = r"(?i)test|example|sample|fixture|mock|docs?/"

FEATURES = [
    "length", "changes", "digits", "upper", "vowels", "marks", "variety", "hex", "coverage",
    "path_test", "path_deep", "cue", "assigned", "quoted", "doubt", "sentence",
]


def _found(text: Column) -> Column:
    """Every candidate with its place (code points) and what stands before and after it."""
    cuts = F.split(text, _CANDIDATE, -1)
    parts = F.transform(
        F.regexp_extract_all(text, F.lit(_CANDIDATE), F.lit(0)),
        lambda m, i: F.struct(m.alias("value"), F.get(cuts, i).alias("before"), F.get(cuts, i + 1).alias("after")),
    )
    kept = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    return F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast(kept).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["before"]) + F.length(x["value"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["before"])).alias("start"), (acc["at"] + F.length(x["before"]) + F.length(x["value"])).alias("end"),
                x["value"].alias("value"), F.right(x["before"], F.lit(40)).alias("before"), F.left(x["after"], F.lit(20)).alias("after"),
            )).cast(kept)).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """``doc_id``, ``path``, ``row_key`` and the array ``found`` for every row."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select("doc_id", where.alias("path"), whole_text().alias("text"))
    return rows.select("doc_id", "path", F.md5(F.concat_ws("\u0000", "path", "text")).alias("row_key"), _found(F.col("text")).alias("found"))


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def _features(rows: DataFrame) -> DataFrame:
    """All features but the dictionary's."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    changes = r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[+/_-])[A-Za-z0-9]"
    columns = {
        "length": F.least(F.length(v), F.lit(200)), "changes": _share(v, changes), "digits": _share(v, "[0-9]"),
        "upper": _share(v, "[A-Z]"), "vowels": _share(v, "[aeiouAEIOU]"), "marks": _share(v, "[+/_-]"),
        "variety": F.size(F.array_distinct(F.split(F.left(v, F.lit(64)), ""))) / F.least(F.length(v), F.lit(64)),
        "hex": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "path_test": F.col("path").rlike(_TEST_PATH),
        "path_deep": F.least(F.regexp_count("path", F.lit("/")), F.lit(8)), "cue": before.rlike(_CUE),
        "assigned": before.rlike("[=:]\\s{0,2}[\"']?$"), "quoted": before.rlike("[\"']$") & after.rlike("^[\"']"),
        "doubt": before.rlike(_PLACEHOLDER) | after.rlike(_PLACEHOLDER) | v.rlike(_PLACEHOLDER),
        "sentence": before.rlike(r"(?:^|[a-z,;] )$") & after.rlike(r"^(?: [a-z]|[.,;]|$)"),
    }
    return rows.withColumns({k: c.cast("double") for k, c in columns.items()})


def dictionary(docs: DataFrame, least: int = 20) -> DataFrame:
    """Lower-case words of three letters or more that the corpus repeats at least ``least`` times."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(whole_text()), F.lit("(?<![a-z])[a-z]{3,20}(?![a-z])"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")


def known_formats(rows: DataFrame) -> Column:
    """Labels of candidates whose kind is known: 1 secret, 0 not, NULL unknown."""
    plain = F.col("value").rlike("^[A-Z]?[a-z]+$|^[A-Z]+$") & (F.col("cue") == 0)
    return F.when((F.col("doubt") == 1) & ~F.col("value").rlike(_ISSUED), 0).when(F.col("value").rlike(_ISSUED), 1).when(
        (F.col("cue") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0), 1,
    ).when(plain | ((F.col("sentence") == 1) & (F.col("digits") == 0)), 0)


def scored(
    docs: DataFrame, labelled: Callable[[DataFrame], Column] = known_formats, *, path: str = "source", train: int = 10_000,
    trees: int = 30, depth: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """All rows with their candidates' keys, and every candidate with its features, label and ``score``."""
    rows = stored(candidates(docs, path), "candidates")
    found = _features(rows.dropDuplicates(["doc_id", "row_key"]).select("doc_id", "path", "row_key", F.inline("found")))
    pieces = found.select("value", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)))).alias("piece"))
    pieces = pieces.distinct().withColumn("word", F.lower("piece"))
    covered = pieces.join(dictionary(docs), "word").groupBy("value").agg(F.sum(F.length("piece")).alias("known"))
    found = found.join(covered, "value", "left").withColumn("coverage", F.least(F.coalesce("known", F.lit(0)) / F.length("value"), F.lit(1.0))).drop("known")
    found = stored(found.withColumn("label", labelled(found)), "findings")
    known = found.where("label IS NOT NULL").withColumn("at", F.xxhash64("doc_id", "start", "value"))
    chosen = [known.where(F.col("label") == c).orderBy("at", "doc_id", "start").limit(train) for c in (0, 1)]
    sample = stored(chosen[0].unionByName(chosen[1]).select(*FEATURES, F.col("label").cast("double").alias("label")), "sample")
    both = sample.groupBy("label").count().count() == 2
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if both:
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, cacheNodeIds=False).fit(vectors.transform(sample))
        found = forest.transform(vectors.transform(found)).withColumn("score", vector_to_array("probability")[1])
    else:
        found = found.withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.5)))
    return rows, found.select("doc_id", "row_key", "start", "end", "value", *FEATURES, "label", "score")


def scan(docs: DataFrame, accept: float = 0.5, **settings: object) -> DataFrame:
    """``doc_id``, number of ``candidates`` and the accepted ``secrets`` (start, end, value, score) of every row."""
    rows, found = scored(docs, **settings)
    by_row = found.where(F.col("score") >= accept).groupBy("doc_id", "row_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "value", "score"))).alias("secrets"),
    )
    keys = rows.select("doc_id", "row_key", F.size("found").cast("long").alias("candidates"))
    joined = keys.join(by_row.withColumnsRenamed({"doc_id": "id", "row_key": "key"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key")), "left")
    empty = F.array().cast("array<struct<start:int,end:int,value:string,score:double>>")
    return joined.select("doc_id", "candidates", F.coalesce("secrets", empty).alias("secrets"))
