"""Scalar normalisers as Column expressions. All stay JVM-side; none is a UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hosts that count as the platform's own, and relation names with their canonical forms.
PLATFORM_HOSTS = ("twitter.com", "www.twitter.com", "x.com", "www.x.com", "pic.twitter.com", "t.co")
FOLLOW_RELATIONS = ("following",)
FOLLOWER_RELATIONS = ("follower", "followers", "followed")
TWEET_RELATIONS = {
    "post": "post", "retweet": "retweet", "retweeted": "retweet", "quote": "quote", "quoted": "quote", "reply": "reply", "replied": "reply",
    "mention": "mention", "mentioned": "mention",
}
POST_TYPES = ("original", "retweet", "comment_reply", "link_share")
POST_DETAILS = ("original", "retweet", "reply", "quote_comment", "link_share", "other")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_hexdigest(seed: int | str, *parts: str | Column) -> Column:
    """SHA-1 hex of seed|part|part...: the basis of every reproducible order."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]))


def to_int(x: str | Column) -> Column:
    """Null, blank and garbage are 0, thousands separators go, fractions are cut off, booleans are 0 or 1."""
    text = F.lower(F.trim(F.regexp_replace(col(x).cast("string"), ",", "")))
    number = text.try_cast("double")
    flag = F.when(text == "true", 1).when(text == "false", 0)
    whole = F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)
    return F.coalesce(whole.try_cast("long"), flag.cast("long"), F.lit(0).cast("long"))


def to_count(x: str | Column) -> Column:
    return F.greatest(to_int(x), F.lit(0).cast("long"))


def to_float(x: str | Column) -> Column:
    """Blank, garbage, NaN and infinities are 0."""
    number = F.trim(col(x).cast("string")).try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(number)


def strict_float(x: str | Column) -> Column:
    """Blank is 0; garbage raises, as a cast under ANSI rules does."""
    text = F.trim(col(x).cast("string"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).otherwise(text.cast("double"))


def blank_to_null(x: str | Column) -> Column:
    """Blank and null-like texts (none, null, nan) are null."""
    text = F.trim(col(x).cast("string"))
    return F.when(F.lower(text).isin("", "none", "null", "nan"), None).otherwise(text)


def first_present(*paths: str | Column) -> Column:
    """The first of some nested columns that is not null; strings count only if not blank."""
    return F.coalesce(*[F.when(F.trim(col(p).cast("string")) == "", None).otherwise(col(p)) for p in paths])


def nested(json: str | Column, *paths: str) -> Column:
    """The first path ($.a.b) that a JSON text has, as a string."""
    return F.coalesce(*[F.get_json_object(col(json), p) for p in paths])


def user_id(*candidates: str | Column) -> Column:
    """The first present id; a row without any raises."""
    found = first_present(*[col(c).cast("string") for c in candidates])
    return F.when(found.isNull(), F.raise_error(F.lit("no identifier in record")).cast("string")).otherwise(found)


def canonical_user_id(x: str | Column) -> Column:
    """Digits, or digits after u or U, become u and the digits; other ids stay."""
    text = F.trim(col(x).cast("string"))
    return F.when(text.rlike("^[uU]?[0-9]+$"), F.concat(F.lit("u"), F.regexp_extract(text, "([0-9]+)$", 1))).otherwise(text)


def followers(*candidates: str | Column) -> Column:
    return to_count(first_present(*(candidates or ("followers_count", "public_metrics.followers_count"))))


def followings(*candidates: str | Column) -> Column:
    return to_count(first_present(*(candidates or ("friends_count", "following_count", "public_metrics.following_count"))))


def tweet_counts(*candidates: str | Column) -> Column:
    return to_count(first_present(*(candidates or ("statuses_count", "tweet_count", "public_metrics.tweet_count"))))


def verified_bucket(x: str | Column) -> Column:
    text = F.lower(F.trim(col(x).cast("string")))
    return F.when(text.isin("true", "1", "yes"), "true").when(text.isin("false", "0", "no"), "false").otherwise("missing")


def label(x: str | Column) -> Column:
    text = F.lower(F.trim(col(x).cast("string")))
    return F.when(text.isin("bot", "1", "true"), "bot").when(text.isin("human", "0", "false"), "human").when(F.coalesce(text, F.lit("")) == "", "missing").otherwise(text)


def split(x: str | Column) -> Column:
    text = F.lower(F.trim(col(x).cast("string")))
    return F.when(text.isin("dev", "val", "valid", "validation"), "valid").when(F.coalesce(text, F.lit("")) == "", "missing").otherwise(text)


def follow_edge(source: str | Column, target: str | Column, relation: str | Column) -> Column:
    """struct(source, target) from follower to followed, null for other relations."""
    name = F.lower(F.trim(col(relation)))
    forward = F.struct(col(source).alias("source"), col(target).alias("target"))
    back = F.struct(col(target).alias("source"), col(source).alias("target"))
    return F.when(name.isin(*FOLLOW_RELATIONS), forward).when(name.isin(*FOLLOWER_RELATIONS), back)


def tweet_relation(relation: str | Column) -> Column:
    """post, retweet, quote, reply or mention; null for anything else."""
    names = F.create_map(*[F.lit(x) for pair in TWEET_RELATIONS.items() for x in pair])
    return F.try_element_at(names, F.lower(F.trim(col(relation))))


#: Zone names of RFC 2822 dates and their offsets (fixed values of that format).
ZONES = {"+0000": "GMT|UTC|UT|Z", "-0300": "ADT", "-0400": "AST|EDT", "-0500": "EST|CDT", "-0600": "CST|MDT", "-0700": "MST|PDT", "-0800": "PST"}


def parse_timestamp(x: str | Column) -> Column:
    """RFC 2822 or legacy platform dates (weekday cut off) first, then ISO 8601; naive ones are UTC, in a session of any zone; failures are null."""
    text = F.trim(col(x).cast("string"))
    day = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},? ", ""), r"\s*\([^)]*\)$", "")
    for offset, names in ZONES.items():
        day = F.regexp_replace(day, rf"(?<=\d) ({names})(?=$| \d{{4}}$)", f" {offset}")
    day = F.when(day.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} [0-9:]+$"), F.concat(day, F.lit(" +0000"))).otherwise(day)
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}.*([Zz]|[+-]\d{2}(:?\d{2}){0,2})$")
    iso = F.when(zoned, text).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z")))
    formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "MMM dd HH:mm:ss Z yyyy")
    return F.coalesce(*[F.try_to_timestamp(day, F.lit(f)) for f in formats], F.try_to_timestamp(iso))


def utc_hour(df: DataFrame, x: str) -> Column:
    """The hour in UTC of a column, in a session of any zone; timestamps without a zone are UTC."""
    return F.hour(x) if dict(df.dtypes)[x] == "timestamp_ntz" else F.pmod(F.expr(f"floor(unix_seconds(`{x}`) / 3600)"), F.lit(24)).cast("int")


def half_even(x: Column) -> Column:
    """The nearest whole number, halves to even."""
    return F.bround(x, 0).cast("long")


def percentile(x: str | Column, p: float) -> Column:
    """Linear interpolation at (n - 1) p, then the nearest whole number."""
    return half_even(F.percentile(col(x), F.lit(p)))


def quantile_edges(x: str | Column, parts: int = 4) -> Column:
    return F.transform(F.percentile(col(x), F.array(*[F.lit(k / parts) for k in range(1, parts)])), half_even)


def bucket(x: str | Column, edges: Column, parts: int = 4) -> Column:
    """q1, q2, ... by the first edge that is not below x, so ties stay together; null is missing."""
    out = F.when(col(x).isNull(), "missing")
    for k in range(parts - 1):
        out = out.when(col(x) <= edges[k], f"q{k + 1}")
    return out.otherwise(f"q{parts}")


def even_indices(n: Column, limit: int) -> Column:
    """Which 0-based places of n to take so that at most `limit` are spread evenly: round(i (n-1) / (limit-1)), halves to even."""
    if limit <= 0:
        return F.array().cast("array<long>")
    if limit == 1:
        return F.when(n > 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: half_even(i * (n - 1) / F.lit(limit - 1)))
    return F.when(n <= limit, F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))).otherwise(F.array_distinct(spread))


def referenced_ids(refs: str | Column) -> Column:
    """Distinct ids of an array of (id, type) records."""
    return F.array_distinct(F.filter(F.transform(col(refs), lambda r: r["id"].cast("string")), lambda x: x.isNotNull() & (x != "")))


def url_entries(entities: str | Column) -> Column:
    return F.filter(col(entities)["urls"], lambda u: u.isNotNull())


def host(url: Column) -> Column:
    parsed = F.try_parse_url(url, F.lit("HOST"))
    return F.lower(F.coalesce(parsed, F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)", 1)))


def is_external(url: Column) -> Column:
    h = host(url)
    return F.coalesce((h != "") & ~h.isin(*PLATFORM_HOSTS), F.lit(False))


def has_external_url(urls: str | Column, fields: Sequence[str] = ("expanded_url", "display_url", "url")) -> Column:
    return F.coalesce(F.exists(col(urls), lambda u: is_external(F.coalesce(*[u[f] for f in fields]))), F.lit(False))


def excerpt(text: str | Column, limit: int = 160, mark: str = "...", collapse: bool = True) -> Column:
    t = F.trim(F.regexp_replace(col(text), r"\s+", " ")) if collapse else F.trim(col(text))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - len(mark))), F.lit(mark)))


def degree_proxy(a: str | Column, b: str | Column) -> Column:
    return col(a) + col(b)


def pool(tweets: str | Column, primary: int = 8) -> Column:
    return F.when(col(tweets) >= primary, "primary").when(col(tweets) >= 1, "sparse").otherwise("none")


def safe_ratio(x: str | Column, total: str | Column) -> Column:
    return col(x) / F.greatest(col(total), F.lit(1))


def log1p_count(x: str | Column) -> Column:
    return F.log1p(F.greatest(col(x), F.lit(0)).cast("double"))


def choose_text(primary: str | Column, fallback: str | Column) -> Column:
    """struct(text, source): the primary text, else the fallback, else missing."""
    a, b = (F.nullif(F.trim(F.coalesce(col(x), F.lit(""))), F.lit("")) for x in (primary, fallback))
    return F.struct(F.coalesce(a, b, F.lit("")).alias("text"), F.when(a.isNotNull(), "primary").when(b.isNotNull(), "fallback").otherwise("missing").alias("source"))


def slugify_float(x: str | Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", col(x).cast("double")), "0+$", ""), r"\.$", "")
    return F.replace(F.replace(text, F.lit("-"), F.lit("neg")), F.lit("."), F.lit("p"))


def post_type(text: str | Column, references: str | Column, urls: str | Column, reply_to: str | Column | None = None) -> Column:
    """struct(coarse, detail, confidence) by rule: retweet, reply, quote, external link; null fields where no rule decides."""
    of = lambda kind: F.coalesce(F.exists(col(references), lambda r: F.lower(F.trim(r["type"])) == kind), F.lit(False))
    answered = F.lit(False) if reply_to is None else F.coalesce(col(reply_to).cast("string") != "", F.lit(False))
    rule = (
        F.when(of("retweeted") | F.coalesce(F.ltrim(col(text)).startswith("RT @"), F.lit(False)), 1)
        .when(of("replied_to") | answered, 2).when(of("quoted"), 3).when(has_external_url(urls), 4)
    )

    def pick(*values: object) -> Column:
        out = F.when(rule == 1, F.lit(values[0]))
        for k, v in enumerate(values[1:], 2):
            out = out.when(rule == k, F.lit(v))
        return out

    return F.struct(
        pick("retweet", "comment_reply", "comment_reply", "link_share").alias("coarse"),
        pick("retweet", "reply", "quote_comment", "link_share").alias("detail"), pick(0.99, 0.99, 0.95, 0.9).alias("confidence"),
    )


def post_type_response(coarse: str | Column, detail: str | Column, confidence: str | Column) -> Column:
    """A model's answer within the taxonomy: unknown coarse types are original, unknown details original or other, bad confidences null."""
    c, d = F.lower(F.trim(col(coarse))), F.lower(F.trim(col(detail)))
    c = F.when(c.isin(*POST_TYPES), c).otherwise("original")
    d = F.when(d.isin(*POST_DETAILS), d).when(c == "original", "original").otherwise("other")
    return F.struct(c.alias("coarse"), d.alias("detail"), col(confidence).cast("string").try_cast("double").alias("confidence"))
