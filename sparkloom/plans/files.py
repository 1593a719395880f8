"""Sources and sinks: files are written from the supplied tables, and what the readers find in them is compared with the tables."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import scratch
from sparkloom.operators import align, browse, evidence, jobs, structdiff, triggers
from sparkloom.plans.tables import table
from sparkloom.registry import query
from sparkloom.sources import dumps, objects, pages, rules, sheets, sinks, versions, workbooks


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _nations(spark: SparkSession, d: str) -> list[tuple[int, str, int]]:
    """The 25 nations: a table of fixed size, for the files that are small by nature."""
    return [tuple(r) for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


def _customers(spark: SparkSession, d: str, as_objects: bool = False) -> DataFrame:
    """A dump of entries with a post for each order, as JSON lines or as objects."""
    post = F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("tweet_id"), F.col("o_orderpriority").alias("text"))
    posts = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(post)).alias("twitter"))
    rows = table(spark, d, "customer").join(posts, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey")
    entry = F.struct(
        F.when(k % 3 == 0, F.col("c_name")).alias("Label"), F.when(k % 3 != 0, F.col("c_name")).alias("label"), F.when(k % 2 == 0, "o").otherwise("p").alias("ent_type"),
        F.col("c_mktsegment").alias("verband"), F.struct("twitter").alias("social_media"),
    )
    if as_objects:
        path = scratch.new_path(spark, "dump")
        objects.write(rows.select(F.concat(F.lit("c"), k.cast("string")).alias("entry_id"), F.to_json(entry).alias("entry")), path)
        return dumps.entries(spark, path)
    path = scratch.new_path(spark, "dump") + ".jsonl"
    rows.select(F.to_json(F.struct(F.concat(F.lit("c"), k.cast("string")).alias("entry_id"), entry.alias("entry")))).write.text(path)
    return dumps.entries(spark, path)


_DUMP_POSTS = """
SELECT 'c' || c_custkey AS entry_id, c_name AS label, CASE WHEN c_custkey % 2 = 0 THEN 'o' ELSE 'p' END AS ent_type, c_mktsegment AS verband, 'twitter' AS platform,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS ordinal, CAST(o_orderkey AS VARCHAR) AS post_id, o_orderpriority AS text
FROM orders JOIN customer ON o_custkey = c_custkey"""


def _dump_posts(dump: DataFrame) -> DataFrame:
    raw = dumps.raw_posts(dump)
    return raw.select("entry_id", "label", "ent_type", "verband", "platform", "ordinal", F.try_variant_get("raw", "$.tweet_id", "string").alias("post_id"), F.try_variant_get("raw", "$.text", "string").alias("text"))


@query("dump_posts", _DUMP_POSTS)
def dump_posts(spark: SparkSession, d: str) -> DataFrame:
    return _dump_posts(_customers(spark, d))


@query("dump_object_posts", _DUMP_POSTS)
def dump_object_posts(spark: SparkSession, d: str) -> DataFrame:
    """The same posts out of files of one JSON object each, which are read by ranges of bytes."""
    return _dump_posts(_customers(spark, d, as_objects=True))


@query("dump_labels", "SELECT DISTINCT c_name AS label FROM customer WHERE c_custkey % 2 = 1")
def dump_labels(spark: SparkSession, d: str) -> DataFrame:
    return dumps.labels_of(_customers(spark, d), "p")


@query("dump_object", "SELECT 'n' || n_nationkey AS entry_id, n_name AS label, CAST(generate_subscripts([1, 2], 1) - 1 AS INTEGER) AS ordinal FROM nation WHERE n_regionkey <> 0")
def dump_object(spark: SparkSession, d: str) -> DataFrame:
    """A dump of one JSON object; entries without posts give no rows."""
    path = scratch.new_path(spark, "dump") + ".json"
    scratch.put(spark, path, json.dumps({f"n{k}": {"label": name, "social_media": {"x": [{"a": 1}, {"a": 2}] if region else []}} for k, name, region in _nations(spark, d)}))
    return dumps.raw_posts(dumps.entries(spark, path)).select("entry_id", "label", "ordinal")


@query("ledger_rows", "SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS reviewed_at, 'r' || n_regionkey AS edited FROM nation")
def ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a ledger that is written and read, with those of an absent one, which are none."""
    folder = scratch.new_path(spark, "ledger")
    scratch.put(spark, f"{folder}/l.json", sinks.ledger_text({f"k{k}": {"reviewed_at": name if k % 2 == 0 else None, "alt_text_edited": f"r{region}"} for k, name, region in _nations(spark, d)}))
    return dumps.ledger(spark, f"{folder}/l.json").unionByName(dumps.ledger(spark, f"{folder}/absent.json"))


def _rule_file(spark: SparkSession, header: str, lines: list[str]) -> str:
    path = _uri(scratch.new_path(spark, "rules")) + ".csv"
    scratch.put(spark, path, "\n".join(["# for whoever edits this", header, "  # indented", *lines, ""]))
    return path


@query("label_rules", """
SELECT kind, rule, arg_max(value, nth) AS value FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'exact' ELSE 'prefix' END AS kind, 'R' || n_regionkey AS rule, n_name AS value, n_nationkey AS nth FROM nation WHERE n_nationkey % 7 <> 0)
GROUP BY kind, rule""")
def label_rules(spark: SparkSession, d: str) -> DataFrame:
    """Of several rules for one label the last counts; rows without a value are left out."""
    lines = [f"{'prefix' if k % 2 else 'exact'},R{region},{name if k % 7 else ' '},note" for k, name, region in _nations(spark, d)]
    exact, prefix = rules.label_rules(_rule_file(spark, "kind,wrong,correct,note", lines))
    return spark.createDataFrame([("exact", *x) for x in exact.items()] + [("prefix", *x) for x in prefix.items()], "kind string, rule string, value string")


@query("level_rules", """
SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'exact' ELSE 'prefix' END AS kind, n_name AS rule, 'L' || n_regionkey AS level, CASE WHEN n_nationkey % 3 <> 0 THEN max(length(n_name)) FILTER (n_nationkey % 3 <> 0) OVER () - length(n_name) END AS behind
FROM nation""")
def level_rules(spark: SparkSession, d: str) -> DataFrame:
    """Whole labels, and prefixes with how much shorter they are than the first one, which is the longest."""
    lines = [f"{'prefix' if k % 3 else 'exact'},{name},L{region}" for k, name, region in _nations(spark, d)]
    exact, prefix = rules.level_rules(_rule_file(spark, "kind,key,level", lines))
    found = [("exact", *x, None) for x in exact.items()] + [("prefix", *x, len(prefix[0][0]) - len(x[0])) for x in prefix]
    return spark.createDataFrame(found, "kind string, rule string, level string, behind long")


@query("override_rules", """
SELECT 'person' AS kind, n_name AS rule, CASE WHEN n_regionkey = 1 THEN '' ELSE 'F' || n_nationkey END || '|L' || n_nationkey || '|' || CASE WHEN n_nationkey % 2 = 0 THEN 'u' || n_nationkey ELSE '' END AS value FROM nation
UNION ALL SELECT 'organisation', n_name, 'C' || n_regionkey FROM nation UNION ALL SELECT 'screenshot', 'new' || n_nationkey || '.png', 'old' || n_nationkey || '.png' FROM nation WHERE n_regionkey <> 2""")
def override_rules(spark: SparkSession, d: str) -> DataFrame:
    n = _nations(spark, d)
    people = rules.person_overrides(_rule_file(spark, "label,first_name,last_name,sync_uuid", [f"{name},{'' if region == 1 else f'F{k}'},L{k},{f'u{k}' if k % 2 == 0 else ''}" for k, name, region in n]))
    organisations = rules.organisation_overrides(_rule_file(spark, "current_name,canonical_name", [f"{name},C{region}" for _, name, region in n]))
    names = rules.name_map(_rule_file(spark, "name_neu,name_alt", [f"new{k}.png,{'' if region == 2 else f'old{k}.png'}" for k, _, region in n]))
    found = [("person", k, f"{v[0]}|{v[1]}|{v[2] or ''}") for k, v in people.items()] + [("organisation", *x) for x in organisations.items()] + [("screenshot", *x) for x in names.items()]
    return spark.createDataFrame(found, "kind string, rule string, value string")


@query("alt_text_rows", "SELECT 'i' || n_regionkey AS stem, arg_max(n_name, n_nationkey) AS alt_text FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey % 5 <> 0 GROUP BY n_regionkey")
def alt_text_rows(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "alt") + ".json"
    scratch.put(spark, path, json.dumps([{"id": f"i{region}", "status": "ERROR" if k % 4 == 0 else "OK", "alt_text": " " if k % 5 == 0 else name} for k, name, region in _nations(spark, d)]))
    return dumps.alt_texts(spark, path)


@query("report_address_rows", """
SELECT 'f' || n_nationkey AS fds_link, CASE WHEN n_nationkey % 3 = 0 THEN 'u' || n_nationkey END AS single,
  CASE WHEN n_nationkey % 3 <> 0 THEN '["A"]=u' || n_nationkey || CASE WHEN n_nationkey % 3 = 2 THEN ';["B","' || n_name || '"]=v' ELSE '' END END AS pairs FROM nation WHERE n_nationkey % 3 <> 1
UNION ALL SELECT 'f' || n_nationkey, NULL, '["A"]=u' || n_nationkey || ';["B","' || n_name || '"]=v' FROM nation WHERE n_nationkey % 3 = 1""")
def report_address_rows(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "reports") + ".json"
    made = [{"FdS_links": f"f{k}", "capitle_structur": [["A"], ["B", name]], "urls_zur_webseite": [f"u{k}"] if k % 3 == 0 else [f"u{k}", "v", "beyond"]} for k, name, _ in _nations(spark, d)]
    scratch.put(spark, path, json.dumps(made))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("by_path")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return dumps.report_addresses(spark, path).select("fds_link", "single", pairs.alias("pairs"))


@query("paged_rows", "SELECT n_regionkey AS region, n_nationkey AS id, n_name AS label, n_nationkey % 2 = 0 AS wanted FROM nation")
def paged_rows(spark: SparkSession, d: str) -> DataFrame:
    """One paged scan a region, and the same rows again by an id filter that is pushed to the source."""
    pages.register(spark)
    root, size, found = _uri(scratch.new_path(spark, "paged")), 2, None
    n = _nations(spark, d)
    for region in sorted({r for _, _, r in n}):
        own = [{"id": k, "label": name} for k, name, r in n if r == region]
        for at in range(0, len(own), size):
            scratch.put(spark, f"{root}/{region}/{at}.json", json.dumps({"meta": {"result": {"total": len(own)}}, "data": own[at : at + size]}))
        one = spark.read.format("paged").option("url", f"{root}/{region}").option("page_size", size).load()
        one = one.select(F.lit(region).alias("region"), "id", F.get_json_object("body", "$.label").alias("label"))
        found = one if found is None else found.union(one)
    even = found.filter(F.col("id").isin(*[k for k, _, _ in n if k % 2 == 0])).select(F.col("id").alias("even"))
    return found.join(even, F.col("id") == F.col("even"), "left").select("region", "id", "label", F.col("even").isNotNull().alias("wanted"))


@query("review_sheet", "SELECT 'k' || n_nationkey AS id, CASE WHEN n_regionkey = 0 THEN '' ELSE '<' || n_name || '> & \"ü\"' END AS alt_text_edited FROM nation")
def review_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Two workbooks written and read back as a folder of review sheets."""
    n = _nations(spark, d)
    with tempfile.TemporaryDirectory() as folder:  # the driver's own: it writes and reads workbooks itself
        for part in (0, 1):
            sheets.write(str(Path(folder) / f"{part}.xlsx"), ["id", "other", "alt_text_edited"], [[f"k{k}", k, f'<{name}> & "ü"' if region else None] for k, name, region in n if k % 2 == part])
        rows = [(r["id"], r["alt_text_edited"]) for r in sheets.review_rows(folder)]
    return spark.createDataFrame(rows, "id string, alt_text_edited string")


@query("exported_sheet", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, '' AS nothing FROM supplier")
def exported_sheet(spark: SparkSession, d: str) -> DataFrame:
    """One workbook, written by one task and read by another."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.lit(None).cast("string").alias("nothing"))
    path = scratch.new_path(spark, "sheet")
    workbooks.write_shards(rows.withColumn("shard", F.lit(1)), ["s_suppkey"], path)
    return workbooks.read_shards(spark, path, rows.columns).drop("shard")


@query("sharded_sheets", "SELECT CAST(ntile(7) OVER (ORDER BY c_custkey) AS INTEGER) AS shard, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def sharded_sheets(spark: SparkSession, d: str) -> DataFrame:
    """All customers in seven balanced workbooks, each written by a task of its own, and back."""
    path, rows = scratch.new_path(spark, "sheets"), table(spark, d, "customer").select("c_custkey", "c_name")
    workbooks.write_shards(evidence.shards(rows, ["c_custkey"], 7), ["c_custkey"], path, "review")
    return workbooks.read_shards(spark, path, ["c_custkey", "c_name"])


@query("exported_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents")
def exported_csv(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, with line breaks and quotes, as CSV and back."""
    path = scratch.new_path(spark, "export")
    sinks.export(table(spark, d, "documents").select("doc_id", "text"), path, "csv")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\u0000").option("emptyValue", "").option("lineSep", "\n").csv(path)
    return back.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("exported_json", "SELECT doc_id, text, lang FROM documents")
def exported_json(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "export")
    sinks.json_lines(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return spark.read.schema("doc_id long, text string, lang string").json(path)


@query("export_names", "SELECT 'export' || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '_' || n_nationkey END || CASE WHEN n_regionkey % 2 = 0 THEN '.csv' ELSE '.xlsx' END AS name, n_regionkey = 3 AS refused FROM nation")
def export_names(spark: SparkSession, d: str) -> DataFrame:
    def made(k: int, region: int) -> tuple[str, bool]:
        name = sinks.file_name("xlsx" if region % 2 else "csv", k if k % 2 else None)
        try:
            sinks.file_name("pdf" if region == 3 else "csv")
        except ValueError:
            return name, True
        return name, False

    return spark.createDataFrame([made(k, region) for k, _, region in _nations(spark, d)], "name string, refused boolean")


@query("published_concurrently", """
SELECT 'customers' AS name, c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'suppliers', s_suppkey FROM supplier UNION ALL SELECT 'parts', p_partkey FROM part WHERE p_partkey % 3 = 0""")
def published_concurrently(spark: SparkSession, d: str) -> DataFrame:
    """Publishers that began with the same state: those of different tables all count, the second one of a table does not, nor
    one that has read a table published meanwhile."""
    root = scratch.new_path(spark, "published")
    c, s, p = (table(spark, d, t) for t in ("customer", "supplier", "part"))
    sinks.publish_all(spark, {"customers": c, "suppliers": s.limit(0)}, root)
    base = sinks.versions(spark, root)[0]
    sinks.publish_all(spark, {"suppliers": s}, root, base)
    sinks.publish_all(spark, {"customers": c.filter("c_custkey % 2 = 0")}, root, base)
    sinks.publish_all(spark, {"parts": p.filter("p_partkey % 3 = 0")}, root, base)
    for tables, reads in (({"customers": c.limit(0)}, ()), ({"parts": p.limit(0)}, ("suppliers",))):
        try:
            sinks.publish_all(spark, tables, root, base, reads)
        except versions.Conflict:
            continue
        raise AssertionError("a conflict was not seen")
    found = [sinks.current(spark, root, n).select(F.lit(n).alias("name"), F.col(k).alias("id")) for n, k in (("customers", "c_custkey"), ("suppliers", "s_suppkey"), ("parts", "p_partkey"))]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("published_tables", "SELECT 'customers' AS name, c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'suppliers', s_suppkey FROM supplier")
def published_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two tables are published, then one anew; a job that fails between its tables in the end leaves no trace."""
    root, c, s = scratch.new_path(spark, "published"), table(spark, d, "customer"), table(spark, d, "supplier")
    sinks.publish_all(spark, {"customers": c, "suppliers": s}, root)
    sinks.publish_all(spark, {"customers": c.filter("c_custkey % 2 = 0")}, root)
    broken = s.withColumn("s_name", F.raise_error(F.lit("broken off")).cast("string"))
    try:
        sinks.publish_all(spark, {"customers": c.limit(0), "suppliers": broken}, root)
    except Exception as e:  # the engine's own, of whatever class
        if "broken off" not in str(e):
            raise
    return sinks.current(spark, root, "customers").select(F.lit("customers").alias("name"), F.col("c_custkey").alias("id")).union(sinks.current(spark, root, "suppliers").select(F.lit("suppliers"), "s_suppkey"))


@query("job_log", """
SELECT * FROM (VALUES ('parliaments', true, '{"nations": "published"}', ''), ('elections', true, '{"regions": "published"}', ''), ('periods', false, NULL, 'no answer')) t(operation, success, changes, notes)""")
def job_log(spark: SparkSession, d: str) -> DataFrame:
    """Jobs in their fixed order: the third fails, those behind it do not run; a job whose settings are wrong stops all before any; a
    dry run and a job without tables log nothing."""
    root = scratch.new_path(spark, "jobs")

    def fails() -> dict[str, DataFrame]:
        raise RuntimeError("no answer")

    made = {
        "mandates": jobs.Job("mandates", lambda: {"never": table(spark, d, "nation")}), "periods": jobs.Job("periods", fails),
        "elections": jobs.Job("elections", lambda: {"regions": table(spark, d, "region")}), "parliaments": jobs.Job("parliaments", lambda: {"nations": table(spark, d, "nation")}),
    }
    jobs.run(spark, [made["parliaments"]], root, dry_run=True)
    jobs.run(spark, [jobs.Job("nothing", dict)], root)
    for attempt in ([*made.values(), jobs.Job("x", dict, [lambda: "party is not set"])], jobs.in_order(made)):
        try:
            jobs.run(spark, attempt, root)
        except (ValueError, RuntimeError):
            continue
    return spark.read.parquet(f"{root}/runs").select("operation", "success", "changes", "notes")


@query("dry_run", "SELECT n_nationkey, n_name, false AS written FROM nation")
def dry_run(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a dry run, and whether anything was published."""
    root = scratch.new_path(spark, "dry")
    planned = jobs.run(spark, [jobs.Job("a", lambda: {"nations": table(spark, d, "nation")})], root, dry_run=True)
    return planned["nations"].select("n_nationkey", "n_name", F.lit(sinks.current(spark, root, "nations") is not None).alias("written"))


@query("change_hooks", """
SELECT 'gone' AS hook, 'shot' || n_nationkey || '.png' AS told FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0
UNION ALL SELECT 'rules', CAST(n AS VARCHAR) FROM (VALUES (1), (2)) t(n)""")
def change_hooks(spark: SparkSession, d: str) -> DataFrame:
    """Posts that go give their files to a hook; a hook on rules runs once for each publication that changes them."""
    root, found = scratch.new_path(spark, "hooks"), []
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("shot"), F.col("n_nationkey").cast("string"), F.lit(".png"))).alias("screenshot"))
    rules_ = table(spark, d, "region").select("r_regionkey", "r_name")
    hooks = triggers.Triggers()
    hooks.add("posts", ["n_nationkey"], lambda c: found.extend(("gone", r["path"]) for r in triggers.owned_files(c, "screenshot").toLocalIterator()))
    hooks.add("rules", ["r_regionkey"], lambda c: found.append(("rules", str(sum(k == "rules" for k, _ in found) + 1))))
    for made in ({"posts": n, "rules": rules_}, {"posts": n.filter("n_regionkey <> 2"), "rules": rules_}, {"rules": rules_.withColumn("r_name", F.lower("r_name"))}):
        jobs.run(spark, [jobs.Job("import", lambda made=made: made)], root, triggers=hooks)
    return spark.createDataFrame(found, "hook string, told string")


@query("deferred_columns", """
WITH t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT d.doc_id, source, CASE WHEN t.doc_id IS NOT NULL THEN length(text) END AS size FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""")
def deferred_columns(spark: SparkSession, d: str) -> DataFrame:
    """Documents without their texts, which are recalled for those that are shown, the toxic ones."""
    docs = table(spark, d, "documents")
    light = browse.deferred(docs, ("text", "absent")).select("doc_id", "source")
    wanted = table(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct()
    shown = browse.recalled(light.join(wanted, "doc_id", "left_semi"), "doc_id", docs, ("text",))
    rest = light.join(wanted, "doc_id", "left_anti").withColumn("size", F.lit(None).cast("int"))
    return shown.select("doc_id", "source", F.length("text").alias("size")).unionByName(rest)


@query("request_parameters", """
SELECT n_nationkey AS k, CASE WHEN n_regionkey <> 1 THEN n_nationkey END AS number, TRY_CAST(CASE WHEN n_nationkey < 20 THEN '2023-02-' || (n_nationkey + 20) ELSE 'x' END AS DATE) AS day, CASE WHEN n_regionkey <> 2 THEN 1990 + n_nationkey END AS year,
  CASE WHEN n_regionkey <> 3 THEN n_nationkey END AS chapter, n_regionkey <> 4 AS filtered, CASE WHEN n_nationkey = 0 THEN '' ELSE (2000 + n_nationkey) || '-01-01' END AS first_day FROM nation""")
def request_parameters(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for k, _, region in _nations(spark, d):
        number, day = browse.param_int(f" {k} " if region != 1 else f"{k}²"), browse.param_date(f"2023-02-{k + 20}" if k < 20 else "x")
        year, chapter = browse.param_year(f"{1990 + k}-x" if region != 2 else "x"), browse.param_chapter(["no", str(k)] if region != 3 else ["no"])
        filtered = browse.has_filters({"q": " ", "page": "2"} if region == 4 else {"actor": "1"})
        rows.append((k, number, day, year, chapter, filtered, browse.years_to_dates(2000 + k, 2024, 2000, 2024)[0]))
    return spark.createDataFrame(rows, "k long, number long, day date, year long, chapter long, filtered boolean, first_day string")


@query("position_overrides", """
SELECT s_suppkey AS person, 'Sprecher*in' AS role, CAST(NULL AS VARCHAR) AS level FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'Abgeordnete*r', 'AfD-Bundespartei' FROM supplier WHERE s_suppkey % 2 = 0""")
def position_overrides(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    held = s.select(F.col("s_suppkey").alias("person"), F.col("s_name").alias("name"), F.lit("alt").alias("label"))
    tags = s.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("person"), F.lit("Sprecher*in").alias("role"), F.lit(None).cast("string").alias("level"))
    overrides = s.filter("s_suppkey % 2 = 0").select(F.lower("s_name").alias("name"), F.lit("MdB").alias("position"))
    return align.position_overrides(held, overrides, tags, ["AfD-Bundespartei"])[1]


@query("structural_diff", """
SELECT '- /' || c_name || ' : "label ' || c_custkey || '"' AS line FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT '~ /' || c_name || '/region : ' || c_nationkey || ' -> ' || (c_nationkey + 1) FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT '~ /' || c_name || '/posts[id=' || c_custkey || ']/n : 1 -> 2' FROM customer WHERE c_custkey % 3 = 2
UNION ALL SELECT '+ /' || c_name || '/posts[] : {"b": "ü", "k": ' || c_custkey || '}' FROM customer WHERE c_custkey % 3 = 2""")
def structural_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two dumps with an entry for each customer, of which some are gone, some have another region and lists in another order, and some
    have a changed post and a further one."""
    k = F.col("c_custkey")

    def entry(rows: DataFrame, region: Column, posts: str) -> DataFrame:
        text = F.concat(F.lit('{"label": "label '), k, F.lit('", "region": '), region, F.lit(', "posts": ['), F.replace(F.lit(posts), F.lit("#"), k.cast("string")), F.lit("]}"))
        return rows.select(F.col("c_name").alias("entry_id"), F.parse_json(text).alias("entry"))

    rows, region = table(spark, d, "customer"), F.col("c_nationkey")
    before = entry(rows, region, '{"id": #, "t": "same", "n": 1}, "s"')
    moved = entry(rows.filter(k % 3 == 1), region + 1, '"s", {"n": 1, "id": #, "t": "same"}')
    return structdiff.diff(before, moved.unionAll(entry(rows.filter(k % 3 == 2), region, '"s", {"k": #, "b": "ü"}, {"id": #, "t": "same", "n": 2}')))
