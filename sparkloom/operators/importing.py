"""The import of a prepared dump: normalized posts and their report data to accounts, posts, evidence, mentions and originators.

Every table's new state and change log come from one full join of what is stored with what comes in. A second run of the same dump
changes nothing. Keys are natural ones; nothing is numbered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import or_empty
from sparkloom.functions.values import clean_path, iso_timestamp, merged_flag, parse_duration, slug
from sparkloom.operators.checks import require
from sparkloom.operators.evidence import expanded_mentions, last_linkable, merged_reports
from sparkloom.operators.people import owners
from sparkloom.operators.upsert import Policy, change_log, first_by, freshest, matched, new_state

ACCOUNTS = "platform string, platform_user_id string, username string, display_name string, description string, url string, follower_count long, is_verified boolean, actor long, collected_at timestamp"
POSTS = "platform string, platform_user_id string, platform_post_id string, url string, posted_at timestamp, edited_at timestamp, text string, title string, description string, view_count long, like_count long, comment_count long, share_count long, redistributes string"
EVIDENCE = "platform string, platform_user_id string, platform_post_id string, slug string, documentation_date date"
MENTIONS = "slug string, footnote string, originator long, chapter_structure array<string>, citation string, report_url string, start_s long, end_s long"
ORIGINATORS = "slug string, actor long"
SCHEMAS = {"account": ACCOUNTS, "post": POSTS, "evidence": EVIDENCE, "mention": MENTIONS, "originator": ORIGINATORS}
KEYS = {"account": ["platform", "platform_user_id"], "post": ["platform", "platform_user_id", "platform_post_id"], "evidence": ["platform", "platform_user_id", "platform_post_id"], "mention": ["slug", "footnote"], "originator": ["slug", "actor"]}
LISTS = ["topic", "footnote_id", "fliesstext", "report_urls", "starts", "ends", "originators"]
_POST_KEY = ["platform", "platform_user_id", "platform_post_id"]


@dataclass(frozen=True)
class Import:
    """Each table's matched rows (see ``upsert.matched``)."""

    changes: dict[str, DataFrame]

    def state(self, table: str) -> DataFrame:
        return new_state(self.changes[table]).select(*[c.split(" ")[0] for c in SCHEMAS[table].split(", ")])

    def log(self) -> DataFrame:
        named = {t: c.withColumn("key", F.concat_ws(":", *[F.col(k).cast("string") for k in KEYS[t]])) for t, c in self.changes.items()}
        return change_log(named, "key")


def _account_rows(posts: DataFrame) -> DataFrame:
    a = "account"
    return posts.filter(f"{a}.platform_user_id IS NOT NULL").select(
        "platform", F.col(f"{a}.platform_user_id").alias("platform_user_id"), F.col(f"{a}.username").alias("username"), F.col(f"{a}.display_name").alias("display_name"), F.col(f"{a}.description").alias("description"),
        F.col(f"{a}.url").alias("url"), F.col(f"{a}.follower_count").alias("follower_count"), merged_flag(F.col(f"{a}.is_verified"), F.col(f"{a}.is_blue_verified")).alias("is_verified"), "collected_at", "ordinal",
    )


def run(posts: DataFrame, stored: dict[str, DataFrame], index: DataFrame) -> Import:
    """``posts`` has platform, ordinal (a total order of occurrences), actor (whose entry lists the post), account_labels, the columns of
    a normalized post, and report_data as the lists of ``LISTS`` but originators; ``index`` is a name index."""
    p = posts.withColumn("platform_user_id", F.col("account.platform_user_id")).withColumn("collected_at", iso_timestamp(F.col("collected_at")))
    # accounts: the newest snapshot of each; an owner if all its labels agree; owners are added, never taken away
    snapshots = freshest(_account_rows(p), KEYS["account"], "collected_at", "ordinal")
    labels = p.select(F.concat_ws(":", "platform", "platform_user_id").alias("a"), F.explode("account_labels").alias("label"))
    owned = owners(labels, "a", "label", index).filter("actor IS NOT NULL").select(F.col("a").alias("__a"), F.col("actor").cast("long").alias("actor"))
    snapshots = snapshots.join(owned, F.concat_ws(":", "platform", "platform_user_id") == F.col("__a"), "left").drop("__a", "ordinal")
    stubs = p.select("platform", F.explode("references").alias("r")).filter("r.account.platform_user_id IS NOT NULL")
    stub_accounts = stubs.select("platform", F.col("r.account.platform_user_id").alias("platform_user_id"), F.col("r.account.username").alias("username"), F.col("r.account.display_name").alias("display_name"), F.col("r.account.url").alias("url"), merged_flag(F.col("r.account.is_verified"), F.col("r.account.is_blue_verified")).alias("is_verified"))
    stub_accounts = first_by(stub_accounts, KEYS["account"], F.col("username"), F.col("url"))
    known = stored["account"].select(*KEYS["account"]).union(snapshots.select(*KEYS["account"])).distinct()
    stub_accounts = stub_accounts.join(known, KEYS["account"], "left_anti")
    accounts = snapshots.unionByName(stub_accounts, allowMissingColumns=True)
    profile = frozenset(c.split(" ")[0] for c in ACCOUNTS.split(", ")) - {"platform", "platform_user_id", "actor"}
    account = matched(stored["account"], accounts.select(*stored["account"].columns), KEYS["account"], Policy(fill_null=profile, fill_empty=frozenset(["actor"]), fresh="collected_at"))
    # posts: the fields of the first occurrence
    first = first_by(p.filter("platform_post_id IS NOT NULL"), _POST_KEY, F.col("ordinal"))
    last = last_linkable(F.coalesce("references", F.array().cast(dict(posts.dtypes)["references"])))
    rows = first.select(
        *_POST_KEY, or_empty(F.col("url")).alias("url"), iso_timestamp(F.col("created_at")).alias("posted_at"), iso_timestamp(F.col("edited_at")).alias("edited_at"), or_empty(F.col("text")).alias("text"), or_empty(F.col("title")).alias("title"),
        or_empty(F.col("description")).alias("description"), "view_count", "like_count", "comment_count", "share_count", last["platform_post_id"].alias("redistributes"),
    )
    stub_posts = stubs.filter("r.platform_post_id IS NOT NULL").select("platform", F.col("r.account.platform_user_id").alias("platform_user_id"), F.col("r.platform_post_id").alias("platform_post_id"), or_empty(F.col("r.url")).alias("url"), iso_timestamp(F.col("r.created_at")).alias("posted_at"), or_empty(F.col("r.text")).alias("text"))
    stub_posts = first_by(stub_posts, _POST_KEY, F.col("posted_at"), F.col("text"))
    known_posts = stored["post"].select(*_POST_KEY).union(rows.select(*_POST_KEY)).distinct()
    stub_posts = stub_posts.join(known_posts, _POST_KEY, "left_anti").withColumns({"title": F.lit(""), "description": F.lit("")})
    post = matched(stored["post"], rows.unionByName(stub_posts, allowMissingColumns=True).select(*stored["post"].columns), _POST_KEY)
    # evidence: one for each main post; its date follows the newest collection
    keyed = p.filter("platform_post_id IS NOT NULL").withColumn("slug", slug(F.col("platform"), F.col("platform_post_id")))
    dated = keyed.groupBy(*_POST_KEY, "slug").agg(F.to_date(F.max("collected_at")).alias("documentation_date"))
    evidence = matched(stored["evidence"], dated.select(*stored["evidence"].columns), _POST_KEY, Policy(fill_null=frozenset(["documentation_date"])))
    # mentions: lists of all occurrences, one after the other; a topic without footnote aborts; of equal footnotes the last one counts
    size = F.greatest(*[F.size(F.coalesce(c, F.array())) for c in ("topic", "footnote_id", "fliesstext")])
    attributed = keyed.withColumn("originators", F.array_repeat(F.col("actor").cast("long"), size))
    merged = merged_reports(attributed, "slug", "ordinal", LISTS)
    found, bad = expanded_mentions(merged, "slug", LISTS, "topic", "footnote_id")
    require(bad, "a topic has no footnote")
    mention = first_by(found, ["slug", "footnote_id"], F.desc("nth")).select(
        "slug", F.col("footnote_id").alias("footnote"), F.col("originators").alias("originator"), clean_path(F.col("topic")).alias("chapter_structure"), or_empty(F.col("fliesstext")).alias("citation"), or_empty(F.col("report_urls")).alias("report_url"),
        parse_duration(F.col("starts")).alias("start_s"), parse_duration(F.col("ends")).alias("end_s"),
    )
    touched = merged.filter((F.size("topic") > 0) | (F.size("footnote_id") > 0)).select("slug")
    old = stored["mention"]
    rest = old.join(touched, "slug", "left_anti")
    mentions = matched(old.join(touched, "slug", "left_semi"), mention.select(*old.columns), KEYS["mention"], Policy(delete_missing=True))
    untouched = rest.select(*KEYS["mention"], F.lit("kept").alias("op"), *[F.struct(*[c for c in old.columns if c not in KEYS["mention"]]).alias(n) for n in ("old", "result")])
    # originators: only ever added
    pairs = keyed.filter("actor IS NOT NULL").select("slug", F.col("actor").cast("long").alias("actor")).distinct()
    held = lambda df: df.select("slug", "actor", F.lit(True).alias("held"))
    originators = matched(held(stored["originator"]), held(pairs), KEYS["originator"])
    return Import({"account": account, "post": post, "evidence": evidence, "mention": mentions.unionByName(untouched), "originator": originators})


def empty_state(spark) -> dict[str, DataFrame]:
    return {t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()}
