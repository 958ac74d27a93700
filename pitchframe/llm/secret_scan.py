"""Secret scan with ownership frequency over the whole corpus. DataFrame functions only.

Candidates are found in every whole text: the three base kinds, and a wider pattern of long mixed tokens. Every
candidate value is hashed; the hashes are counted by distinct repositories and owners, combined before each shuffle.
A value that many owners hold, or twice as many repositories, is an example that was copied; one that a single owner holds and that looks live (long,
of mixed characters) is that owner's credential. Wide candidates that turn out to be such credentials are added to the
spans as kind `owned`; base spans always stay.

Spans are of whole matches, in code points, end exclusive. A regular expression gives matches but no places, so the text
is split by the same expression: the lengths of the parts between matches and of the matches add up to places.

Defined results: null texts count as empty; a null owner or repository counts as one of its own; rows that repeat an id
each get their row, and those that repeat its text too count its places once; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import documents, landed, text_of

# The base patterns, and the least length of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same matches as a run after AKIA that is 20 or longer in all
HEX = r"[0-9a-f]{24,}"  # the same as whole runs of 24 or more
KINDS = ["assign", "access", "hex", "owned"]
LEAST_ASSIGN = 6
BLOCK = 64  # parts of a text whose places are added up together
#: Long tokens that aren't base candidates by themselves, and that must hold a small letter, a capital and a digit.
WIDE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"


def found_spans(text: Column, pattern: str, kind: str, value: int = 0) -> Column:
    """An array of (start, kind, end, value) of the matches of pattern, leftmost and non-overlapping."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else hits
    lengths = F.transform(F.split(text, pattern, -1), F.length)
    hit = "struct<start:int,kind:int,end:int,value:string>"
    long = lambda x: x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))

    def walk(parts: Column, start: Column) -> Column:
        """Spans of a block of parts that begins at start."""
        return F.aggregate(
            parts,
            F.struct(start.alias("at"), F.array().cast(f"array<{hit}>").alias("out")),
            lambda so_far, x: F.struct(
                (so_far["at"] + long(x)).alias("at"),
                F.when(x["hit"].isNull(), so_far["out"])
                .otherwise(
                    F.concat(
                        so_far["out"],
                        F.array(
                            F.struct(
                                (so_far["at"] + x["gap"]).alias("start"),
                                F.lit(KINDS.index(kind)).alias("kind"),
                                (so_far["at"] + long(x)).alias("end"),
                                x["value"].alias("value"),
                            )
                        ),
                    )
                )
                .alias("out"),
            ),
            lambda so_far: so_far["out"],
        )

    def placed(parts: Column) -> Column:
        # arrays that grow are copied at each step: those of a block are short, and of blocks only the starts are added up
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, BLOCK))
        sums = F.transform(blocks, lambda own: F.aggregate(own, F.lit(0), lambda n, x: n + long(x)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), walk))

    parts = F.arrays_zip(lengths.alias("gap"), hits.alias("hit"), values.alias("value"))
    spans = F.element_at(F.transform(F.array(parts), placed), 1)  # bound to a name, else each block would search the text again
    none = F.array().cast(f"array<{hit}>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def listed(spans: Column) -> Column:
    """kind:start:end of spans in order, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def of_kind(spans: Column, kind: int) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def candidates(docs: DataFrame, text: Column) -> DataFrame:
    """docs with `base`, the sorted base spans, and `wide`, the spans of the wider pattern."""
    assign = F.filter(found_spans(text, ASSIGN, "assign", 2), lambda x: F.length(x["value"]) >= LEAST_ASSIGN)
    base = F.array_sort(F.concat(assign, found_spans(text, ACCESS, "access"), found_spans(text, HEX, "hex")))
    mixed = F.filter(
        found_spans(text, WIDE, "owned"),
        lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]"),
    )
    return docs.withColumns({"base": base, "wide": mixed})


def looks_live(value: Column) -> Column:
    """Long enough, of letters and digits, and not one character again and again."""
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= 16) & (kinds >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def ownership(held: DataFrame, copied_from: int) -> DataFrame:
    """held(digest, repo, owner, live) to digest, n_repos, n_owners, n_places, standing."""
    pairs = held.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n"), F.max("live").alias("live"))
    owners = pairs.groupBy("digest", "owner").agg(
        F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"), F.max("live").alias("live")
    )
    counted = owners.groupBy("digest").agg(
        F.sum("repos").alias("n_repos"),
        F.count(F.lit(1)).alias("n_owners"),
        F.sum("n").alias("n_places"),
        F.max("live").alias("live"),
    )
    copied = (F.col("n_owners") >= copied_from) | (F.col("n_repos") >= 2 * copied_from)
    standing = (
        F.when(copied, "example")
        .when((F.col("n_owners") == 1) & F.col("live"), "owned")
        .otherwise("unclear")
    )
    return counted.withColumn("standing", standing)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo: Column | None = None,
    copied_from: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(spans, values): the spans of each row with the standing of their values, and the standing of each value.

    Values are only kept as digests. Rows of spans: doc_id, mark (which tells repeated ids apart by text), base, added,
    n_owned, n_example."""
    text = text_of(text_col)
    repo = F.col(owner_col) if repo is None else repo
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text, F.length(text)).alias("mark"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        text.alias("text"),
    )
    sealed = lambda x: F.struct(  # noqa: E731  values don't leave the scan
        x["start"].alias("start"),
        x["kind"].alias("kind"),
        x["end"].alias("end"),
        F.sha2(x["value"], 256).alias("digest"),
        looks_live(x["value"]).alias("live"),
    )
    marked = candidates(own, F.col("text")).drop("text")
    marked = landed(marked.withColumns({c: F.transform(c, sealed) for c in ("base", "wide")}), "secret-spans")
    every = marked.select("doc_id", "mark", "owner", "repo", F.explode(F.concat("base", "wide")).alias("x")).select(
        "doc_id",
        "mark",
        "owner",
        "repo",
        "x.*",
    )
    values = ownership(every.select("digest", "repo", "owner", "live"), copied_from)
    placed = every.select("doc_id", "mark", "start", "kind", "end", "digest").join(
        values.select("digest", "standing"), "digest"
    )
    base = F.col("kind") < KINDS.index("owned")
    added = ~base & (F.col("standing") == "owned")
    place = F.struct("start", "kind", "end")
    rows = placed.groupBy("doc_id", "mark").agg(  # sets: rows that repeat id and text have the same places
        F.array_sort(F.collect_set(F.when(added, place))).alias("added"),
        F.size(F.collect_set(F.when(base & (F.col("standing") == "owned"), place))).cast("long").alias("n_owned"),
        F.size(F.collect_set(F.when(base & (F.col("standing") == "example"), place))).cast("long").alias("n_example"),
    )
    alone = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    spans = marked.select("doc_id", "mark", alone.alias("base"))
    rows = rows.withColumnsRenamed({"doc_id": "r_id", "mark": "r_mark"})
    same = spans["doc_id"].eqNullSafe(rows["r_id"]) & (spans["mark"] == rows["r_mark"])
    return spans.join(rows, same, "left").drop("r_id", "r_mark"), values


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_example.

    The owner is the source, the repository a language of it."""
    spans, _ = scan(documents(spark, sf_dir), repo=F.concat_ws("/", "source", "lang"))
    counts = {f"n_{kind}": of_kind(F.col("base"), k) for k, kind in enumerate(KINDS[:3])}
    both = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return spans.select(
        "doc_id",
        *[c.alias(name) for name, c in counts.items()],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(both).alias("spans"),
        F.coalesce("n_owned", F.lit(0)).alias("n_owned"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
