"""Registered queries of single functions and small operators, with their SQL. Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import normalize as N
from murmur.functions import vectors as V
from murmur.operators import community, evaluate, experiments, features, graph, sampling
from murmur.plans import bindings as B
from murmur.plans import catalog as C
from murmur.plans.bindings import longs, rounded, table
from murmur.plans.catalog import query
from murmur.sources import scans

# --- scalar functions ----------------------------------------------------------------------------------------------------------------------


@query("""
select c_custkey, 'u' || c_custkey as user_id, greatest(trunc(c_acctbal)::bigint, 0) as followers, c_nationkey::bigint as following,
    case when c_custkey % 2 = 0 then c_custkey % 7 else 0 end::bigint as tweets, case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then c_mktsegment else 'x' end as first_of,
    case when c_custkey % 4 > 1 then (c_custkey % 4)::varchar end as filled, case c_custkey % 4 when 0 then 1.5 else 0 end::double as number
from customer""")
def alias_columns(spark: SparkSession, d: str) -> DataFrame:
    """Ids and counters by their aliases, the first present of some fields, blank and null-like texts, numbers with defaults."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    c = c.withColumns({
        "blank": F.when(key % 3 != 0, "  "), "other": F.when(key % 2 == 0, key % 7).cast("string"), "n": F.when(key % 3 == 0, F.col("c_name")),
        "m": F.when(key % 3 == 1, F.col("c_mktsegment")).otherwise(""), "void": F.element_at(F.array(F.lit(" NaN"), F.lit("none"), F.lit(" 2 "), F.lit("3")), (key % 4 + 1).cast("int")),
        "text": F.element_at(F.array(F.lit(" 1.5"), F.lit("inf"), F.lit(""), F.lit("x1")), (key % 4 + 1).cast("int")),
    })
    return c.select(
        "c_custkey", N.canonical_user_id(N.user_id("blank", F.concat(F.lit("U"), key))).alias("user_id"), N.followers("blank", "c_acctbal").alias("followers"), N.followings("blank", "c_nationkey").alias("following"),
        N.tweet_counts("blank", "other").alias("tweets"), N.first_present("n", "m", F.lit("x")).alias("first_of"), N.blank_to_null("void").alias("filled"), N.to_float("text").alias("number"),
    )


@query("""
select doc_id, case when length(t) <= 160 then t else rtrim(t[:157], ' ') || '...' end as excerpt, case when length(p) <= 60 then p else rtrim(p[:57], ' ') || '...' end as plain
from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as t, trim(text, ' ') as p from documents)""")
def text_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", N.excerpt("text").alias("excerpt"), N.excerpt("text", 60, collapse=False).alias("plain"))


@query("""
select c_custkey, coalesce(n, 0) + c_nationkey as degree, case when coalesce(n, 0) >= 8 then 'primary' when coalesce(n, 0) >= 1 then 'sparse' else 'none' end as pool,
    round(c_nationkey / greatest(coalesce(n, 0), 1)::double, 6) as ratio
from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey""")
def degree_pools(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left").na.fill(0, ["n"])
    return rounded(c.select("c_custkey", N.degree_proxy("n", "c_nationkey").alias("degree"), N.pool("n").alias("pool"), N.safe_ratio("c_nationkey", "n").alias("ratio")), "ratio")


@query("""
with t as (select conv_id, turn, case when turn % 3 = 0 then trim(text, ' ') else '' end as a, case when turn % 3 = 1 then role else '' end as b from conversations)
select conv_id, turn, case when a <> '' then a else b end as text, case when a <> '' then 'primary' when b <> '' then 'fallback' else 'missing' end as source from t""")
def chosen_text(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("turn") % 3
    t = table(spark, d, "conversations").select("conv_id", "turn", N.choose_text(F.when(third == 0, F.col("text")), F.when(third == 1, F.col("role")).otherwise(" ")).alias("t"))
    return t.select("conv_id", "turn", "t.text", "t.source")


@query("""
with t as (select event_id, case when event_id % 3 = 0 then 'retweet' when event_id % 3 = 1 then 'original' else 'original' end as coarse, event_id % 3 as m, value from events)
select event_id, coarse, case when m = 0 then 'other' when m = 1 then 'original' else 'quote_comment' end as detail, case when m = 2 then null else value end as confidence from t""")
def post_type_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model within the taxonomy: known ones, unknown coarse types, unknown details, confidences that are no numbers."""
    k = (F.col("event_id") % 3 + 1).cast("int")
    of = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), k)
    p = N.post_type_response(of(" Retweet", "original", "event"), of("sale", "view", "Quote_Comment"), F.when(k == 3, "high").otherwise(F.col("value").cast("string")))
    return table(spark, d, "events").select("event_id", p.alias("p")).select("event_id", "p.coarse", "p.detail", "p.confidence")


@query("""
with e as (select event_id, [event_id % 5, event_id % 3, null] as ids from events)
select event_id, array_to_string(list_transform(case when ids[1] = ids[2] then [ids[1]] else [ids[1], ids[2]] end, lambda x: x::varchar), ',') as ids, 2::bigint as urls from e""")
def referenced_ids(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids that records refer to, in order, and how many link entries there are; blank and null ones left out."""
    e = table(spark, d, "events")
    record = lambda x: F.struct(x.cast("string").alias("id"), F.lit("quoted").alias("type"))
    refs = F.array(record(F.col("event_id") % 5), record(F.col("event_id") % 3), record(F.lit("")), record(F.lit(None)))
    url = F.struct(F.col("event_type").alias("expanded_url"))
    entities = F.struct(F.array(url, F.lit(None).cast("struct<expanded_url:string>"), url).alias("urls"))
    return e.select("event_id", F.array_join(N.referenced_ids(refs), ",").alias("ids"), F.size(N.url_entries(entities)).cast("long").alias("urls"))


@query("""
with e as (select vec_id, embedding::double[] as v from embeddings), n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from e)
select vec_id, round(case when n > 0 then v[1] / n else v[1] end, 6) as first, len(v)::bigint + 4 as size, n > 1e-12 as signal,
    round(case when vec_id % 3 = 0 then v[2] when vec_id % 3 = 1 then v[1] else (0.7 * v[1] + 0.3 * v[2]) / 1.0 end, 6) as combined
from n""")
def vector_parts(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors, early fusion with padding, whether there is a signal, and the mean of two scores of which one may be missing."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    third = F.col("vec_id") % 3
    a, b = F.when(third != 0, F.col("v")[0]), F.when(third != 1, F.col("v")[1])
    both = V.fused("v", F.array(F.lit(1.0), F.lit(2.0)), 0)
    long = F.size(V.padded("v", 1)) + F.size(both) + F.size("v")
    return rounded(e.select("vec_id", V.normalized("v")[0].alias("first"), (long + 1).cast("long").alias("size"), V.has_signal("v").alias("signal"), V.combine(a, b, 0.7, 0.3).alias("combined")), "first", "combined")


# --- roll-ups and joins --------------------------------------------------------------------------------------------------------------------


@query(f"with {B.MEMBERS} select split, label, count(*) as n from members group by 1, 2")
def split_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return sampling.distribution(B.members(spark, d), "split", "label")


@query(f"""
with {B.MEMBERS}, {C.PRIOR}, {C.PROFILES}, {C.PREDICTED} select split, outcome, count(*) as n from (select split, case when predicted_label = 'bot' then (case when label = 'bot' then 'TP' else 'FP' end)
    else (case when label = 'bot' then 'FN' else 'TN' end) end as outcome from pred where label in ('bot', 'human')) group by 1, 2""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return experiments.confusion(C._predictions(spark, d), ("split",))


@query(f"""
with {B.MEMBERS}, {C.PRIOR}, {C.PROFILES}, {C.PREDICTED}, e as (select user_id, community_id, abs(bot_score - 0.5) as margin, case when predicted_label = 'bot' and label = 'human' then 'FP' when predicted_label = 'human' and label = 'bot' then 'FN' end as kind
    from pred where split = 'test' and label in ('bot', 'human')), r as (select 'FP' as list, user_id, round(margin, 6) as margin, row_number() over (order by margin desc, user_id) as place from e where kind = 'FP'
    union all select 'FN', user_id, round(margin, 6), row_number() over (order by margin desc, user_id) from e where kind = 'FN' union all select 'uncertain', user_id, round(margin, 6), row_number() over (order by margin, user_id) from e)
select list, user_id, margin from r where place <= 20""")
def error_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The largest errors of either kind, and the least certain rows."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("user_id"), F.col("n_chars").cast("double").alias("n_chars"))
    out = experiments.error_analysis(C._predictions(spark, d), t, ["n_chars"], top=20)
    pick = lambda name, key: out[key].select(F.lit(name).alias("list"), "user_id", "margin")
    return rounded(pick("FP", "false_positives").unionByName(pick("FN", "false_negatives")).unionByName(pick("uncertain", "uncertain")), "margin")


@query(f"""
with {B.MEMBERS}, {C.PRIOR}, {C.PROFILES}, r as (select community_id, bot_score, row_number() over (order by bot_score desc, community_size desc, community_id desc) as down, row_number() over (order by bot_score, community_size, community_id) as up from profiles)
select 'bot' as list, community_id, round(bot_score, 6) as bot_score from r where down <= 3 union all select 'human', community_id, round(bot_score, 6) from r where up <= 3""")
def extreme_communities(spark: SparkSession, d: str) -> DataFrame:
    out = experiments.extreme_communities(C._profiles(spark, d), 3)
    return rounded(out["bot"].withColumn("list", F.lit("bot")).unionByName(out["human"].withColumn("list", F.lit("human"))).select("list", "community_id", "bot_score"), "bot_score")


@query("""
with s as (select label, count(*) as size, min(vec_id) as f from embeddings group by 1), n as (select label, size, printf('c%04d', row_number() over (order by size desc, f)) as community_id from s)
select vec_id as node, e.label as community, community_id, size from embeddings e join n using (label)""")
def community_numbers(spark: SparkSession, d: str) -> DataFrame:
    return community.community_ids(C._labels(spark, d))


@query(f"""
with {B.FOLLOWS}, n as (select user_id, count(*) as posts, avg(value) as v from events group by 1), t as (select avg(posts) as mp, stddev_pop(posts) as sp, avg(v) as mv, stddev_pop(v) as sv from n where user_id % 10 <= 6)
select 'u' || user_id as user_id, round((posts - mp) / sp, 6) as z_posts, round((v - mv) / sv, 6) as z_value, 0.0::double as z_flat from n, t""")
def train_zscores(spark: SparkSession, d: str) -> DataFrame:
    """z-scores with the statistics of the train rows alone; a column that does not vary gives 0."""
    u = B.posts(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v")).withColumn("same", F.lit(7))
    out = features.zscores(u, ["n", "v", "same"], fit=F.substring("user_id", 2, 20).cast("long") % 10 <= 6, flat="zero")
    return rounded(out.select("user_id", *[F.col("z")[k].alias(f"z_{c}") for k, c in enumerate(("posts", "value", "flat"))]), "z_posts", "z_value", "z_flat")


@query("""
with p as (select doc_id, max(toxic) as toxic from labels group by 1), a as (select d.doc_id, coalesce(trim(source), '') as community_id, coalesce(case when toxic = 1 then 'bot' when toxic = 0 then 'human' end, 'missing') as label from documents d left join p using (doc_id))
select doc_id::varchar as user_id, community_id, label from a where community_id <> '' and doc_id % 10 <> 0""")
def assignment_labels(spark: SparkSession, d: str) -> DataFrame:
    """Assignments with labels looked up, else their own; rows with a blank id go."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("doc_id").cast("string")).alias("user_id"), F.col("source").alias("community_id"), F.lit("missing").alias("label"))
    known = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("user_id"), F.when(F.col("toxic") == 1, "bot").otherwise("human").alias("label"), "toxic")
    known = known.groupBy("user_id").agg(F.max_by("label", "toxic").alias("label"))
    return evaluate.normalize_assignments(rows, known).select("user_id", "community_id", "label")


@query("""
with t as (select conv_id as user_id, conv_id || '-' || turn as tweet_id, turn, turn % 3 as n, role from conversations)
select user_id, count(*) as tweet_count, sum(n)::bigint as triplet_count, string_agg(tweet_id, ',' order by turn, tweet_id) as tweet_ids, string_agg(role, chr(10) order by turn, role) as triplet_document from t group by 1""")
def triplet_documents(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    rows = c.select(
        F.col("conv_id").alias("user_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("tweet_id"), F.col("turn").alias("ord"),
        F.array_repeat(F.col("role"), (F.col("turn") % 3).cast("int")).alias("triplets"), F.col("role").alias("triplet_text"),
    )
    out = features.triplet_documents(rows)
    return longs(out.withColumn("tweet_ids", F.array_join("tweet_ids", ",")), "triplet_count")


@query("""
with o as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders)
select o_custkey::varchar as id, o_orderkey as last_order from o where r = 1""")
def last_value_map(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.lit("").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderkey").alias("last_order"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return scans.read_map(o, "last_order", "at")


@query("""
with w as (select distinct user_id from events where event_type = 'purchase'), e as (select event_id, user_id, event_type, row_number() over (partition by user_id order by event_id) as r from events where user_id in (select user_id from w))
select user_id, event_id, event_type from e where r = 1""")
def first_records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return scans.lookup(e, e.where("event_type = 'purchase'"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("""
with p as (select l_orderkey as user_id, l_partkey as tweet_id, l_extendedprice as ord, l_linenumber from lineitem), a as (select tweet_id, user_id, row_number() over (partition by tweet_id order by ord desc, user_id desc, l_linenumber desc) as r from p)
select p_partkey as tweet_id, p_name as text, user_id from part join a on p_partkey = tweet_id where r = 1""")
def authors_of(spark: SparkSession, d: str) -> DataFrame:
    """Parts as tweets and the last order that has them as their author."""
    posts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("tweet_id"), F.struct("l_extendedprice", "l_orderkey", "l_linenumber").alias("ord"))
    return features.tweet_authors(table(spark, d, "part").select(F.col("p_partkey").alias("tweet_id"), F.col("p_name").alias("text")), posts).select("tweet_id", "text", "user_id")


@query(f"""
with {B.POSTS}, n as (select user_id, tweet_id, row_number() over (partition by user_id order by sha1('42|derived|' || user_id || '|' || tweet_id), tweet_id) as place, count(*) over (partition by user_id) as n from posts)
select user_id, tweet_id from n where n >= 8 and place <= 20""")
def task_tweets(spark: SparkSession, d: str) -> DataFrame:
    return sampling.select_for_tasks(B.posts(spark, d)).select("user_id", "tweet_id")


@query(f"""
with {B.FOLLOWS}, {C.CLOSURE}, ok as (select count(*) as n from edges where not (source_id in (select id from kept_users) and ((relation = 'post' and target_id in (select id from kept_posts)) or (relation = 'following' and target_id in (select id from kept_users))))),
s as (select 'u' || user_id as id, case when user_id % 10 <= 6 then 'train' when user_id % 10 = 7 then 'valid' else 'test' end as split from (select distinct user_id from events)),
a as (select split, count(*) / sum(count(*)) over ()::double as x from s where id in (select id from kept_users) group by 1), b as (select split, count(*) / sum(count(*)) over ()::double as y from s group by 1)
select (select n from ok) as endpoint_errors, round((select max(abs(coalesce(x, 0) - coalesce(y, 0))) from a full join b using (split)), 6) as split_delta, 0.0::double as label_delta, (select count(*) from kept_posts) as tweets, false as passed""")
def sample_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on half of the users and two thirds of the posts as a sample: ends that are missing, and shares that are off."""
    users, tweets = C._kept(spark, d)
    marked = lambda u: u.select("user_id", F.substring("user_id", 2, 20).cast("long").alias("k")).select("user_id", B.split_of("k").alias("split"), F.lit("human").alias("label"))
    everyone = marked(B.users(spark, d))
    targets = {k: everyone.groupBy(k).agg(F.count(F.lit(1)).alias("n")) for k in ("split", "label")}
    return rounded(sampling.validate(C._edges(spark, d), marked(users), tweets, targets, 10**9).select("endpoint_errors", "split_delta", "label_delta", "tweets", "passed"), "split_delta", "label_delta")


# --- graphs --------------------------------------------------------------------------------------------------------------------------------


@query(f"""
with {B.FOLLOWS}, k as (select source, target from follows), m as (select 'u' || event_id as source, 'u' || user_id as target from events)
select distinct least(source, target) as a, greatest(source, target) as b, count(*) over (partition by least(source, target), greatest(source, target)) as directions from (
    select source, target from k union select target, source from k union select source, target from m union select target, source from m) where source <> target""")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of two sources in both directions, without loops and repeats."""
    named = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    own = table(spark, d, "events").select(named("event_id").alias("source"), named("user_id").alias("target"))
    pairs = graph.candidates(B.follows(spark, d), own)
    return pairs.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).alias("directions"))


DETAILED = f"""{C.MIX}, {C.PAIRS}, sc as (select a, b, 1.0 / (1 + abs(x.n - y.n)) as weight, case when (x.n + y.n) % 2 = 0 then 0.5 end as content from pairs join mix x on a = x.user_id join mix y on b = y.user_id),
bo as (select a as source, b as target, weight, content from sc union all select b, a, weight, content from sc), ra as (select *, row_number() over (partition by source order by weight desc, target) as rank from bo where weight >= 0.05)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    n = C._mix(spark, d)
    rows = C._follow_pairs(spark, d).join(n.selectExpr("user_id as a", "n as x"), "a").join(n.selectExpr("user_id as b", "n as y"), "b")
    rows = rows.select("a", "b", (1 / (1 + F.abs(F.col("x") - F.col("y")))).alias("weight"), F.when((F.col("x") + F.col("y")) % 2 == 0, 0.5).alias("content"))
    return rows.withColumns({c: F.lit(None).cast("double") for c in graph.CHANNELS if c != "content"})


@query(f"with {B.FOLLOWS}, {DETAILED} select source, target, rank, round(weight, 6) as weight from ra where rank <= 5")
def directed_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(longs(graph.directed_topk(_scored(spark, d), 5, 0.05).select("source", "target", "rank", "weight"), "rank"), "weight")


@query(f"with {B.FOLLOWS}, {DETAILED} select least(source, target) as a, greatest(source, target) as b, round(max(weight), 6) as weight, count(*) as support, max(content)::double as content from ra where rank <= 5 group by 1, 2")
def detailed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Undirected edges that keep a channel's score."""
    return rounded(graph.symmetrize(graph.directed_topk(_scored(spark, d), 5, 0.05), "union_max", ("content",)), "weight")


@query(f"with {B.FOLLOWS}, {DETAILED} select round(count(content) / count(*)::double, 6) as content, 0.0::double as behaviour, 0.0::double as temporal, 0.0::double as network from sc")
def channel_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.channel_coverage(_scored(spark, d)), *graph.CHANNELS)


@query("""
with e as (select vec_id, embedding::double[] as v, label from embeddings), s as (select avg(label) as m, stddev_pop(label) as d from e),
f as (select vec_id as id, list_concat(v, [(label - m) / d]) as v from e, s), p as (select a.id as source, b.id as target, list_cosine_similarity(a.v, b.v) as weight from f a join f b on a.id <> b.id)
select source, target, rank, round(weight, 6) as weight from (select *, row_number() over (partition by source order by round(weight, 12) desc, target) as rank from p where weight >= 0.1) where rank <= 5""")
def early_fusion_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of embeddings fused with a z-scored number; weights below a bound go before the ranks."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("user_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    size = e.select(F.max(F.size("embedding"))).first()[0]
    z = features.zscores(e.select("user_id", "label"), ["label"])
    out = graph.early_fusion(features.fused_vectors(e.select("user_id", "embedding"), z, size), 5, 0.1, size + 1)
    return rounded(longs(out.select("source", "target", "rank", "weight"), "rank"), "weight")


@query("""
with r as (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as p from customer)
select c_custkey, round(10 * sqrt(p - 0.5) * cos((p - 1) * pi() * (3 - sqrt(5))), 4) as x, round(10 * sqrt(p - 0.5) * sin((p - 1) * pi() * (3 - sqrt(5))), 4) as y from r""")
def spiral_places(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rounded(experiments.spiral_layout(c, [F.col("c_acctbal").desc(), F.col("c_custkey")], ["c_nationkey"]).select("c_custkey", "x", "y"), "x", "y", places=4)
