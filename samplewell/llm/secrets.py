"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are found by pattern. A further kind, `generic`, takes long random-looking tokens with no telling word before
them. Every candidate value is hashed; the hash is counted over the whole corpus by distinct owners (the column that names
a row's source) and by distinct repositories (another column, if one is given; else documents, which decide nothing). A value that many owners have is a widely copied
example; one that a few owners have is a live-looking credential of theirs. The method's own spans are the generic
candidates that are live by this count and lie outside base spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewell.llm.shared import cut, keyed, mark, once, settle

#: The patterns of the base kinds and their least lengths, in the order in which kinds are listed.
BASE = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: The added kind: 20 or more characters of a token alphabet, with lower and upper case and digits among them.
GENERIC = ("generic", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
KINDS = (*[k[0] for k in BASE], GENERIC[0])
#: A value that at most so many owners have is live-looking; where a column names repositories, at most so many of these as well.
LIVE_OWNERS, LIVE_REPOSITORIES = 2, 8
#: Values with more rows than this are joined through so many salts.
HOT_ROWS, SALTS = 10_000, 64
#: Live spans up to so many (some 20 MB) are broadcast to the rows; more are joined by a shuffle.
BROADCAST_SPANS = 500_000
#: Items of a chunk of a running sum; code points of a piece of a text that is masked.
CHUNK, PIECE = 128, 4096


def _before(values: Column, start: Column, add) -> Column:
    """For each of an array's numbers, what `add` makes of start and those before it; in chunks of CHUNK, so that no fold is long."""
    fold = lambda array: F.aggregate(array, start, add)

    def within(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: fold(F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))
        heads = lambda sums: F.transform(sums, lambda _, c: fold(F.slice(sums, F.lit(1), c)))
        each = lambda h: F.transform(v, lambda _, i: add(F.get(h, F.floor(i / CHUNK).cast("int")), fold(F.slice(v, (F.floor(i / CHUNK) * CHUNK + 1).cast("int"), i % CHUNK))))
        return once(chunks, lambda sums: once(heads(sums), each))

    return F.when(F.size(values) > 0, once(values, within)).otherwise(F.array().cast("array<bigint>"))


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (kind, start, end, value) of one pattern's matches; offsets in code points.

    Matches and the text between them alternate, so a match starts after all that is before it.
    """
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    struct = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"

    def placed(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda x: (F.char_length(x["g"]) + F.char_length(x["m"])).cast("bigint"))
        at = _before(sizes, F.lit(0).cast("bigint"), lambda a, b: a + b)
        return F.transform(F.arrays_zip(pieces.alias("p"), at.alias("at")), lambda x: span(x["p"], x["at"] + F.char_length(x["p"]["g"])))

    def span(piece: Column, start: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(piece["m"])).alias("end"), piece["v"].alias("value"))

    pieces = once(whole, lambda m: F.arrays_zip(m.alias("m"), F.slice(gaps, F.lit(1), F.size(m)).alias("g"), (value if group else m).alias("v")))
    kept = F.filter(once(pieces, placed), lambda s: F.char_length(s["value"]) >= least)
    return F.when(F.regexp_count(text, F.lit(pattern)) > 0, kept).otherwise(F.array().cast(struct))


def _outside(more: Column, base: Column) -> Column:
    """The spans of `more` that overlap none of `base`. All are sorted by start: a span is free if no base span before it ends after its start, and the next one starts no earlier than its end."""
    mark = lambda own: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(own).alias("own"))
    far = F.lit(2**62).cast("bigint")

    def free(events: Column) -> Column:
        ends = F.transform(events, lambda e: F.when(e["own"], F.lit(0).cast("bigint")).otherwise(e["end"]))
        starts = F.transform(F.reverse(events), lambda e: F.when(e["own"], far).otherwise(e["start"]))
        before, after = _before(ends, F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b)), F.reverse(_before(starts, far, lambda a, b: F.least(a, b)))
        kept = F.filter(F.arrays_zip(events.alias("e"), before.alias("b"), after.alias("a")), lambda x: x["e"]["own"] & (x["b"] <= x["e"]["start"]) & (x["a"] >= x["e"]["end"]))
        return F.transform(kept, lambda x: F.struct(F.lit(GENERIC[0]).alias("kind"), x["e"]["start"].alias("start"), x["e"]["end"].alias("end"), x["e"]["value"].alias("value")))

    return F.when((F.size(more) > 0) & (F.size(base) > 0), once(F.array_sort(F.concat(F.transform(more, mark(True)), F.transform(base, mark(False)))), free)).otherwise(more)


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row per candidate span of the whole texts: id, owner, repo, kind, start, end, value_hash (SHA-256; no secret is passed on).

    Null texts have none. A null owner counts as one owner of its own. Ids need not be unique: equal ids are one repository.
    """
    text = F.col("text")
    base = [_spans(text, *k) for k in BASE]
    generic = F.filter(
        _spans(text, *GENERIC),
        lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"),
    )
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.col(repo_col or id_col).cast("string").alias("repo"))
    found = docs.where("text is not null").select("id", "owner", F.coalesce("repo", F.lit("")).alias("repo"), F.concat(*base).alias("base"), generic.alias("more"))
    outside = _outside(F.col("more"), F.col("base"))
    # The outer form: the inner one would add a filter that is pushed down and runs all patterns a second time.
    spans = found.select("id", "owner", "repo", F.explode_outer(F.concat("base", outside)).alias("s")).where("s is not null")
    return spans.select("id", "owner", "repo", "s.kind", "s.start", "s.end", F.sha2("s.value", 256).alias("value_hash"))


def ownership(found: DataFrame, repos: bool = False) -> DataFrame:
    """One row per candidate value: value_hash, rows, owners, repositories (distinct), live (by owners, and by repositories if repos). Counted in two steps, so that a hot value is added up before any shuffle brings its rows together."""
    by = found.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("rows"))
    owners = by.groupBy("value_hash", "owner").agg(F.sum("rows").alias("rows"), F.count("*").alias("repos"))
    # A repository belongs to an owner, so distinct repositories add up over owners.
    out = owners.groupBy("value_hash").agg(F.sum("rows").alias("rows"), F.count("*").alias("owners"), F.sum("repos").alias("repositories"))
    few = F.col("owners") <= LIVE_OWNERS
    return out.withColumn("live", few & (F.col("repositories") <= LIVE_REPOSITORIES) if repos else few)


def judged(found: DataFrame, repos: bool = False) -> DataFrame:
    """The candidates with the corpus counts of their values; rows of hot values are spread over salts."""
    counts = ownership(found, repos)
    salts = F.when(F.col("rows") > HOT_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    hot = counts.where(F.col("rows") > HOT_ROWS).select("value_hash", F.lit(1).alias("hot"))  # at most one in HOT_ROWS candidates
    keyed = found.join(F.broadcast(hot) if _few(hot) else hot, "value_hash", "left")
    keyed = keyed.withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("id", "start"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    return keyed.join(counts.withColumn("salt", F.explode(salts)), ["value_hash", "salt"]).drop("salt")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _few(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row per id: numbers of base spans by kind, digest of the base spans, all spans, and how many are live or widely copied.

    Columns: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied. Null and empty texts have no spans. Rows that
    repeat an id are one document: one output row, spans of equal place and kind once. A null id is an id like another.
    No rows give no rows; other columns of the input are left out.
    """
    found = cut(candidates(df, id_col, text_col, owner_col, repo_col))
    rank = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), 0))
    base = F.col("kind") != GENERIC[0]
    kept = judged(found, repo_col is not None).where(base | F.col("live"))
    by = kept.groupBy("id").agg(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end", "live")).alias("all"))
    by = by.withColumn("base", F.filter("all", lambda s: s["kind"] != GENERIC[0]))
    ids = df.select(F.col(id_col).cast("bigint").alias("id")).distinct()
    out = ids.join(by.withColumnRenamed("id", "found_id"), F.col("id").eqNullSafe(F.col("found_id")), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,live:boolean>>")
    out = out.withColumn("all", F.coalesce("all", none)).withColumn("base", F.coalesce("base", none))
    count = [F.size(F.filter("base", _is(k))).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select(
        F.col("id").alias(id_col), *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda s: s["live"])).cast("bigint").alias("n_live"), F.size(F.filter("all", lambda s: ~s["live"])).cast("bigint").alias("n_copied"),
    )


def mask(df: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """The rows, with all their columns, with each live span replaced by `*` for each code point, so that offsets stay.

    Widely copied values stay. Live generic spans are masked as well. Each row is masked by its own text, whatever its ids: rows with
    null or repeated ids like any other. Rows without secrets and null texts are unchanged; no rows give no rows.
    """
    row = _unused(df, "row")
    rows, since = keyed(df, row), mark()
    found = cut(candidates(rows, row, text_col, owner_col, repo_col))
    spans = judged(found, repo_col is not None).where("live").groupBy(F.col("id").alias(row)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(_unused(df, "spans")))
    spans = settle(spans, since)
    at = F.col(spans.columns[1])
    total = spans.agg(F.sum(F.size(at))).first()[0] or 0
    joined = rows.join(F.broadcast(spans) if total <= BROADCAST_SPANS else spans, row, "left")

    def piece(k: Column) -> Column:
        """The k-th piece of the text with its part of the spans. They are sorted by start and may overlap: only what lies after the last masked place is added."""
        text, first = F.substr(F.col(text_col), (k * PIECE + 1).cast("int"), F.lit(PIECE)), k * PIECE
        here = F.filter(at, lambda s: (s["start"] < first + PIECE) & (s["end"] > first))

        def cover(t: Column):
            def add(state, s):
                begin = F.greatest(state["at"], s["start"] - first)
                end = F.greatest(begin, F.least(s["end"] - first, F.char_length(t).cast("bigint")))
                kept = F.substr(t, (state["at"] + 1).cast("int"), (begin - state["at"]).cast("int"))
                return F.struct(end.alias("at"), F.concat(state["out"], kept, F.repeat(F.lit("*"), (end - begin).cast("int"))).alias("out"))

            rest = lambda s: F.concat(s["out"], F.substr(t, (s["at"] + 1).cast("int"), F.char_length(t)))
            return F.aggregate(here, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), add, rest)

        return once(text, cover)

    pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.char_length(text_col) - 1) / PIECE)), piece)
    masked = F.when(at.isNotNull() & (F.char_length(text_col) > 0), F.array_join(pieces, "")).otherwise(F.col(text_col))
    return joined.withColumn(text_col, masked).select(*df.columns)


def _unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name
