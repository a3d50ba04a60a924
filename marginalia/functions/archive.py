"""Column expressions over posts of a social-media archive and over dates typed by people."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The part of an archived post that the engine reads.
POST = """id_str string, id string, full_text string, text string, created_at string, in_reply_to_status_id string, in_reply_to_screen_name string, retweeted_status string,
 entities struct<hashtags:array<struct<text:string>>,user_mentions:array<struct<screen_name:string>>,urls:array<struct<url:string,expanded_url:string>>,media:array<struct<type:string,media_url:string,media_url_https:string>>>,
 extended_entities struct<media:array<struct<type:string,media_url:string,media_url_https:string>>>"""


def _first(text: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def post_date(text: Column) -> Column:
    """Wall-clock time of a post in the classic form, ISO with or without fractions, or plain; null if it is none of them. Offsets are dropped."""
    classic = F.regexp_extract(text, r"^[A-Za-z]{3} ([A-Za-z]{3} \d{1,2} \d\d:\d\d:\d\d) [+-]\d{4} (\d{4})$", 1)
    year = F.regexp_extract(text, r"(\d{4})$", 1)
    turned = F.when(classic != "", F.concat(year, F.lit(" "), classic)).otherwise(F.regexp_replace(text, r"Z$", ""))
    return _first(turned, "yyyy MMM d HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def typed_day(text: Column) -> Column:
    """A day with the year first or last, its parts joined by hyphens or slashes; null if it is none."""
    return _first(text, "yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy").cast("date")


def _known(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def post_id(post: Column) -> Column:
    return F.coalesce(F.nullif(post["id_str"], F.lit("")), post["id"])


def post_text(post: Column) -> Column:
    return F.coalesce(F.nullif(post["full_text"], F.lit("")), post["text"], F.lit(""))


def attachments(post: Column) -> Column:
    """``array<struct<type, url>>`` of the extended media, or of the plain ones where there are none."""
    extended = post["extended_entities"]["media"]
    media = F.when(F.coalesce(F.size(extended), F.lit(0)) > 0, extended).otherwise(post["entities"]["media"])
    listed = F.transform(media, lambda m: F.struct(F.coalesce(m["type"], F.lit("photo")).alias("type"), F.coalesce(F.nullif(m["media_url_https"], F.lit("")), m["media_url"], F.lit("")).alias("url")))
    return F.coalesce(listed, F.array().cast("array<struct<type:string,url:string>>"))


def post_body(post: Column) -> Column:
    """The text, then its links and its media as lists under their own lines."""
    links = F.filter(F.transform(F.coalesce(post["entities"]["urls"], F.array()), lambda u: u["expanded_url"]), _known)
    media = F.transform(F.filter(attachments(post), lambda m: m["url"] != ""), lambda m: F.concat(F.lit("["), m["type"], F.lit("] "), m["url"]))
    block = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n{name}:\n- "), F.array_join(items, "\n- ")))
    return F.concat_ws("\n", post_text(post), block("Links", links), block("Media", media))


def post_fields(post: Column) -> dict[str, Column]:
    """tweet_id, text, is_retweet, is_reply, reply_to, hashtags, mentions, urls."""
    e, text = post["entities"], post_text(post)
    listed = lambda items, take: F.coalesce(F.transform(items, take), F.array().cast("array<string>"))
    return {
        "tweet_id": post_id(post), "text": text, "is_retweet": text.startswith("RT @") | post["retweeted_status"].isNotNull(), "is_reply": post["in_reply_to_status_id"].isNotNull(), "reply_to": post["in_reply_to_screen_name"],
        "hashtags": listed(e["hashtags"], lambda x: x["text"]), "mentions": listed(e["user_mentions"], lambda x: x["screen_name"]), "urls": listed(e["urls"], lambda x: F.coalesce(x["expanded_url"], x["url"]))}
