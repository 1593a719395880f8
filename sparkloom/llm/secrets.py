"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Candidates are found by regular expressions in whole texts. The hash of each candidate value is then counted over the
corpus by distinct owners and distinct repositories: a value that several owners or many repositories hold is a widely copied
example; one that a single owner holds in few repositories, and that looks random, is a live-looking credential.

Offsets come from splitting the text at the same pattern: the pieces between matches and the matches themselves, summed in turn,
in runs of ``RUN`` matches so that a text of many matches is not copied once a match.

Defined cases: null or empty text has no spans; equal matches at several places are several spans; two kinds may
overlap; repeated rows are each scanned and reported; a null owner or repository counts as one more of its own name; texts
of any length are scanned whole; an empty table gives no rows; other columns are ignored by ``secret_scan`` and returned
as they are, whatever their names, by ``redact``, but for ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import TEXTS, free_name, stage

#: The base kinds in the order in which ties are listed, their patterns, and the least length that a match
#: (for assign: its value) has to reach.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex")
#: Further credential formats that the method adds as spans of kind ``format``.
FORMATS = r"ghp_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: A value is widely copied from so many owners, or so many repositories, on.
FEW_OWNERS, FEW_REPOSITORIES = 2, 16
#: What looks generated: so many characters, so many different ones, a digit.
LIVE_LENGTH = 12
LIVE_SYMBOLS = 8
RUN = 128
_NONE = "array<struct<start:int,kind:int,name:string,end:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, name: str, value_group: int = 0, gate: Column | None = None) -> Column:
    """The matches of ``pattern`` as structs; texts that fail ``gate``, a cheaper necessary condition, have none."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    gaps = F.split(text, pattern, -1)
    none = F.expr(f"cast(array() as {_NONE})")

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(m["gap"])
        end = begin + F.length(m["match"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    each = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("match"), value.alias("value"))

    def run(acc: Column, some: Column) -> Column:
        # (offset so far, spans so far) after each match of the run in turn
        told = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("found")), step)
        return F.struct(told["at"].alias("at"), F.concat(acc["runs"], F.array(told["found"])).alias("runs"))

    starts = F.sequence(F.lit(0), F.floor((F.size(each) - 1) / RUN).cast("int"))
    runs = F.transform(starts, lambda i: F.slice(each, i * RUN + 1, F.lit(RUN)))
    found = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_NONE}>)").alias("runs")), run, lambda acc: F.flatten(acc["runs"]))
    seen = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(seen, found).otherwise(none)


def find_spans(text: Column) -> Column:
    """All spans of a text (start, kind, name, end, value) by start, then kind as listed; offsets are code points."""
    assign = F.filter(_spans(text, ASSIGN, 0, KINDS[0], 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    access = _spans(text, ACCESS, 1, KINDS[1], gate=text.contains("AKIA"))
    hexes = _spans(text, HEX, 2, KINDS[2])
    formats = _spans(text, FORMATS, 3, "format")
    return F.array_sort(F.concat(assign, access, hexes, formats))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _looks_live(value: Column) -> Column:
    """Long enough and of enough different symbols to be generated rather than typed."""
    symbols = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LIVE_LENGTH) & (symbols >= LIVE_SYMBOLS) & value.rlike("[0-9]")


def scanned(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """A staged row for each row of ``docs``: row, doc_id, owner, repository, spans."""
    own = [F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository")]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *own, find_spans(F.coalesce(F.col("text"), F.lit(""))).alias("spans"))
    return stage(rows, "spans")


def ownership(spans: DataFrame) -> DataFrame:
    """value_hash, owners, repositories, occurrences, live of each candidate value in ``spans`` (owner, repository, spans);
    counted in two steps, both combined before the shuffle, so that a value in a third of all rows is one row a task."""
    each = spans.select("owner", "repository", F.explode("spans").alias("s"))
    each = each.select("owner", "repository", F.xxhash64("s.value").alias("value_hash"), _looks_live(F.col("s.value")).alias("live"))
    by_repository = each.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"), F.max("live").alias("live"))
    by_owner = by_repository.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"), F.max("live").alias("live"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences"), F.max("live").alias("live"))


def verdicts(spans: DataFrame, few_owners: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES) -> DataFrame:
    """row, n_live, n_copied, live_at (start and end of its live-looking spans) for each row of ``spans`` with spans."""
    each = spans.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.start", "s.end", F.xxhash64("s.value").alias("value_hash"))
    judged = each.join(ownership(spans).select("value_hash", "owners", "repositories", "live"), "value_hash")
    copied = (F.col("owners") >= few_owners) | (F.col("repositories") >= few_repositories)
    live = ~copied & F.col("live")
    return judged.groupBy("row").agg(F.count_if(live).alias("n_live"), F.count_if(copied).alias("n_copied"), F.collect_list(F.when(live, F.struct("start", "end"))).alias("live_at"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied of each row of ``docs``."""
    spans = scanned(docs)
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    judged = verdicts(spans).select("row", "n_live", "n_copied")
    return spans.join(judged, "row", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def _masked(text: Column, cuts: Column, mark: str) -> Column:
    """``text`` with each of the ``cuts`` (start, end), in order, replaced by ``mark``; overlapping ones are one."""

    def step(acc: Column, cut: Column) -> Column:
        inside = cut["start"] < acc["at"]
        piece = F.concat(F.substr(text, acc["at"] + 1, cut["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], cut["end"]).alias("at"), F.when(inside, acc["text"]).otherwise(F.concat(acc["text"], piece)).alias("text"))

    return F.aggregate(cuts, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step, lambda acc: F.concat(acc["text"], F.substr(text, acc["at"] + 1)))


def redact(docs: DataFrame, mark: str = "[SECRET]", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``docs`` with every live-looking credential's span replaced by ``mark``; other rows and columns unchanged, but that
    ``n_chars``, if there is one, follows the text.

    Texts and spans are written together once, with a number for each row. Rows without a span that could be live are returned from
    there as they are; only the others meet the verdicts, by their number."""
    row, name = free_name(docs, "row"), free_name(docs, "spans")
    held = docs.withColumns({row: F.monotonically_increasing_id(), name: find_spans(F.coalesce(F.col("text"), F.lit("")))})
    held = stage(held, "texts-and-spans", compression=TEXTS)
    spans = held.select(F.col(row).alias("row"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.col(name).alias("spans"))
    suspect = F.exists(name, lambda s: _looks_live(s["value"]))
    cuts = free_name(docs, "cuts")
    chosen = verdicts(spans).filter("n_live > 0").select(F.col("row").alias(row), F.array_sort("live_at").alias(cuts))
    met = held.filter(suspect).drop(name).join(chosen, row, "left")
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(_masked(F.col("text"), F.col(cuts), mark))
    met = met.withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        met = met.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(length))
    return held.filter(~suspect).select(*docs.columns).unionByName(met.select(*docs.columns))
