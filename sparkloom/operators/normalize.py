"""Raw posts of six platforms to one shape. A raw post is a VARIANT; each platform is a projection of paths of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.names import clean_function, swap_comma_name
from sparkloom.functions.values import coerce_int, collected_at, parse_count_text, parse_epoch

ACCOUNT = "struct<username:string,platform_user_id:string,display_name:string,description:string,url:string,follower_count:bigint,is_verified:boolean,is_blue_verified:boolean>"
REFERENCE = f"struct<platform_post_id:string,url:string,created_at:string,text:string,account:{ACCOUNT}>"
#: Columns of a normalized post, in order.
POST = [
    "platform_post_id", "url", "created_at", "edited_at", "collected_at", "text", "title", "description", "transcription", "view_count", "like_count", "comment_count",
    "share_count", "is_comment_disabled", "reactions", "account", "references",
]
_TYPES = {"view_count": "bigint", "like_count": "bigint", "comment_count": "bigint", "share_count": "bigint", "is_comment_disabled": "boolean", "reactions": "map<string,bigint>", "account": ACCOUNT, "references": f"array<{REFERENCE}>"}


def at(raw: Column, path: str, kind: str = "string") -> Column:
    """A path of the raw post, null where it is absent or of another kind."""
    return F.try_variant_get(raw, f"$.{path}", kind)


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _account(**fields: Column) -> Column:
    names = [x.split(":")[0] for x in ACCOUNT[len("struct<") : -1].split(",")]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(ACCOUNT)


def _reference(**fields: Column) -> Column:
    names = ("platform_post_id", "url", "created_at", "text", "account")
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(REFERENCE)


def _present(*references: Column) -> Column:
    return F.filter(F.array(*references), lambda r: r.isNotNull())


def _scraped(raw: Column) -> Column:
    return _iso(collected_at(at(raw, "scraped_time"), at(raw, "scraped_date")))


def telegram(raw: Column) -> dict[str, Column]:
    listed = at(raw, "reactions.results", "array<struct<reaction:struct<emoticon:string>,count:bigint>>")
    counts = F.map_from_entries(F.transform(listed, lambda r: F.struct(r["reaction"]["emoticon"], r["count"])))
    channel, user = at(raw, "fwd_from.from_id.channel_id"), at(raw, "fwd_from.from_id.user_id")
    post, name, date = at(raw, "fwd_from.channel_post"), at(raw, "fwd_from.from_name"), at(raw, "fwd_from.date")
    structured = at(raw, "fwd_from.from_id", "variant").isNotNull() & ~F.is_variant_null(at(raw, "fwd_from.from_id", "variant"))
    by_channel = _reference(platform_post_id=post, url=F.concat(F.lit("https://t.me/c/"), channel, F.lit("/"), post), created_at=date, account=_account(platform_user_id=channel))
    forward = F.when(F.coalesce(structured, F.lit(False)) & channel.isNotNull(), by_channel).when(F.coalesce(structured, F.lit(False)) & user.isNotNull(), _reference(created_at=date, account=_account(platform_user_id=user)))
    forward = forward.when(~F.coalesce(structured, F.lit(False)) & name.isNotNull(), _reference(created_at=date, account=_account(username=name)))
    username = at(raw, "username")
    return {
        "platform_post_id": at(raw, "message_id"), "created_at": at(raw, "date"), "edited_at": at(raw, "edit_date"), "text": at(raw, "message"), "reactions": counts,
        "view_count": coerce_int(at(raw, "views")), "share_count": coerce_int(at(raw, "forwards")), "comment_count": coerce_int(at(raw, "replies.replies")),
        "account": _account(username=username, platform_user_id=at(raw, "channel_id"), display_name=at(raw, "post_author"), url=F.concat(F.lit("https://t.me/"), username)), "references": _present(forward),
    }


def instagram(raw: Column) -> dict[str, Column]:
    username = at(raw, "user.username")
    return {
        "platform_post_id": at(raw, "code"), "created_at": _iso(parse_epoch(at(raw, "taken_at"))), "text": at(raw, "caption.text"), "transcription": at(raw, "video_transcription"),
        "like_count": coerce_int(at(raw, "like_count")), "comment_count": coerce_int(at(raw, "comment_count")),
        "account": _account(username=username, platform_user_id=at(raw, "user.pk"), display_name=at(raw, "user.full_name"), url=F.concat(F.lit("https://www.instagram.com/"), username), is_verified=at(raw, "user.is_verified", "boolean")),
    }


def facebook(raw: Column) -> dict[str, Column]:
    url = at(raw, "author.url")
    named = F.when((url != "") & ~url.contains("people/"), F.replace(url, F.lit("https://www.facebook.com/"), F.lit("")))
    attached = _reference(
        platform_post_id=at(raw, "attached_post.post_id"), url=at(raw, "attached_post.url"), created_at=_iso(parse_epoch(at(raw, "attached_post.timestamp"))), text=at(raw, "attached_post.message"),
        account=_account(platform_user_id=at(raw, "attached_post.author.id"), display_name=at(raw, "attached_post.author.name")),
    )
    has_attached = at(raw, "attached_post.post_id").isNotNull()
    return {
        "platform_post_id": at(raw, "post_id"), "created_at": _iso(parse_epoch(at(raw, "timestamp"))), "text": at(raw, "message"), "comment_count": coerce_int(at(raw, "comments_count")),
        "share_count": coerce_int(at(raw, "reshare_count")), "like_count": coerce_int(at(raw, "reactions.like")), "reactions": at(raw, "reactions", "map<string,bigint>"),
        "account": _account(username=named, platform_user_id=at(raw, "author.id"), display_name=at(raw, "author.name"), url=url), "references": _present(F.when(has_attached, attached)),
    }


def tiktok(raw: Column) -> dict[str, Column]:
    return {
        "platform_post_id": F.coalesce(F.nullif(at(raw, "id"), F.lit("")), at(raw, "vid_id")), "created_at": _iso(parse_epoch(at(raw, "createTime"))), "text": at(raw, "desc"), "transcription": at(raw, "text"),
        "view_count": coerce_int(at(raw, "statsV2.playCount")), "like_count": coerce_int(at(raw, "statsV2.diggCount")), "comment_count": coerce_int(at(raw, "statsV2.commentCount")), "share_count": coerce_int(at(raw, "statsV2.shareCount")),
        "account": _account(username=at(raw, "author.uniqueId"), platform_user_id=at(raw, "author.id"), display_name=at(raw, "author.nickname"), url=F.concat(F.lit("https://www.tiktok.com/@"), at(raw, "author.uniqueId")),
                            description=at(raw, "author.signature"), is_verified=at(raw, "author.verified", "boolean"), follower_count=coerce_int(at(raw, "authorStats.followerCount"))),
    }


def youtube(raw: Column) -> dict[str, Column]:
    channel = at(raw, "channel.id")
    return {
        "platform_post_id": at(raw, "id"), "created_at": at(raw, "publishedTime"), "title": at(raw, "title"), "description": at(raw, "description"), "transcription": at(raw, "transcription"),
        "view_count": coerce_int(at(raw, "viewCount")), "like_count": coerce_int(at(raw, "likeCount")), "comment_count": parse_count_text(at(raw, "commentCountText")), "is_comment_disabled": at(raw, "isCommentDisabled", "boolean"),
        "account": _account(username=at(raw, "channel.handle"), platform_user_id=channel, display_name=at(raw, "channel.name"), url=F.concat(F.lit("https://www.youtube.com/channel/"), channel),
                            is_verified=at(raw, "channel.isVerified", "boolean"), follower_count=parse_count_text(at(raw, "channel.subscriberCountText"))),
    }


def twitter(raw: Column) -> dict[str, Column]:
    def account(user: str) -> Column:
        name = at(raw, f"{user}.username")
        return _account(username=name, platform_user_id=at(raw, f"{user}.user_id"), display_name=at(raw, f"{user}.name"), url=F.concat(F.lit("https://x.com/"), F.lower(F.nullif(name, F.lit("")))), description=at(raw, f"{user}.description"),
                        is_verified=at(raw, f"{user}.is_verified", "boolean"), is_blue_verified=at(raw, f"{user}.is_blue_verified", "boolean"), follower_count=coerce_int(at(raw, f"{user}.follower_count")))

    def status(key: str) -> Column:
        post = at(raw, f"{key}.tweet_id")
        url = F.concat(F.lit("https://x.com/"), at(raw, f"{key}.user.username"), F.lit("/status/"), post)
        return F.when(post.isNotNull(), _reference(platform_post_id=post, url=url, created_at=_iso(parse_epoch(at(raw, f"{key}.timestamp"))), text=at(raw, f"{key}.text"), account=account(f"{key}.user")))

    retweets, quotes = F.coalesce(coerce_int(at(raw, "retweet_count")), F.lit(0)), F.coalesce(coerce_int(at(raw, "quote_count")), F.lit(0))
    return {
        "platform_post_id": at(raw, "tweet_id"), "created_at": _iso(parse_epoch(at(raw, "timestamp"))), "text": at(raw, "text"), "view_count": coerce_int(at(raw, "views")), "like_count": coerce_int(at(raw, "favorite_count")),
        "comment_count": coerce_int(at(raw, "reply_count")), "share_count": F.nullif(retweets + quotes, F.lit(0)), "account": account("user"), "references": _present(status("quoted_status"), status("retweet_status")),
    }


#: The transform of each platform; posts of other platforms are dropped.
PLATFORMS: dict[str, Callable[[Column], dict[str, Column]]] = {"telegram": telegram, "instagram": instagram, "facebook": facebook, "tiktok": tiktok, "youtube": youtube, "twitter": twitter}


def normalized(raw: DataFrame, platform: str = "platform", body: str = "raw") -> DataFrame:
    """``raw`` (platform, a VARIANT body, and any other columns) with the columns of ``POST`` instead of the body, in one scan: a post
    goes through the transform of its own platform alone."""
    others = [c for c in raw.columns if c not in (platform, body)]
    r, own = F.col(body), "__post"
    while own in raw.columns:
        own = "_" + own
    post = None
    for name, transform in PLATFORMS.items():
        fields = {"url": F.coalesce(at(r, "url_corrected"), at(r, "url")), "collected_at": _scraped(r)} | transform(r)
        made = F.struct(*[fields.get(c, F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in POST])
        post = F.when(F.col(platform) == name, made) if post is None else post.when(F.col(platform) == name, made)
    known = raw.filter(F.col(platform).isin(*PLATFORMS))
    return known.select(*others, platform, post.alias(own)).select(*others, platform, *[F.col(own)[c].alias(c) for c in POST])


def dedupe_posts(posts: DataFrame, key: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(the first post of each key, the later ones' differing fields: key, ordinal, field, kept, dropped)."""
    from sparkloom.operators.upsert import first_by

    kept = first_by(posts, [key], F.col(ordinal))
    fields = [c for c in posts.columns if c not in (key, ordinal)]
    first = kept.select(F.col(key).alias("k"), F.col(ordinal).alias("first"), *[F.col(c).alias(f"kept_{c}") for c in fields])
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"kept_{c}").cast("string").alias("kept"), F.col(c).cast("string").alias("dropped")) for c in fields])
    later = posts.join(first, posts[key] == first["k"]).filter(F.col(ordinal) > F.col("first"))
    report = later.select(key, ordinal, F.explode(F.filter(each, lambda d: ~d["kept"].eqNullSafe(d["dropped"]))).alias("d"))
    return kept, report.select(key, ordinal, "d.field", "d.kept", "d.dropped")


def field_survey(posts: DataFrame, platform: str, fields: str) -> DataFrame:
    """platform, field, values: the distinct values of each key of a map of texts."""
    each = posts.select(platform, F.explode(fields).alias("field", "value"))
    return each.groupBy(platform, "field").agg(F.countDistinct("value").alias("values"))


def projected_fields(fields: Column, keep: list[str], rename: dict[str, str], discard: list[str]) -> tuple[Column, Column]:
    """(the kept and renamed entries of a map, its unknown keys); keep comes before rename, rename before discard."""
    known = [*keep, *rename, *discard]
    kept = F.map_filter(fields, lambda k, _: k.isin(keep + list(rename)))
    renamed = F.transform_keys(kept, lambda k, _: F.when(k.isin(keep), k).otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in rename.items() for x in p]) if rename else F.create_map(F.lit(""), F.lit("")), k), k)))
    unknown = F.filter(F.map_keys(fields), lambda k: ~k.isin(known))
    return renamed, unknown


def stem(path: Column) -> Column:
    """A file's name without directory and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def with_alt_text(posts: DataFrame, alt: DataFrame, image: str = "image_file") -> DataFrame:
    """``posts`` with the alternative text of ``alt`` (stem, alt_text) in place of their own, where there is one."""
    found = alt.select(F.col("stem").alias("__stem"), F.col("alt_text").alias("__alt"))
    joined = posts.join(found, stem(F.col(image)) == F.col("__stem"), "left")
    return joined.withColumn("alt_text", F.coalesce("__alt", "alt_text")).drop("__stem", "__alt")


def renamed_screenshots(posts: DataFrame, names: DataFrame, column: str = "screenshot_file") -> DataFrame:
    """The last part of each path replaced by its other name in ``names`` (name_neu, name_alt)."""
    base = F.regexp_extract(F.col(column), r"([^/]*)$", 1)
    joined = posts.join(names.select(F.col("name_neu").alias("__new"), F.col("name_alt").alias("__old")), base == F.col("__new"), "left")
    directory = F.regexp_extract(F.col(column), r"^(.*/)?[^/]*$", 1)
    return joined.withColumn(column, F.when(F.col("__old").isNotNull(), F.concat(directory, F.col("__old"))).otherwise(F.col(column))).drop("__new", "__old")


def report_urls(chapters: Column, by_path: Column, single: Column) -> Column:
    """The report's address for each chapter path: one for all, or by the path's JSON; unresolved: null."""
    return F.transform(chapters, lambda c: F.coalesce(single, F.try_element_at(by_path, F.to_json(c))))


def account_labels(labels: Column) -> Column:
    return F.transform(labels, swap_comma_name)


def functions_cleaned(functions: Column) -> Column:
    return F.transform(functions, clean_function)
