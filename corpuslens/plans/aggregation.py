"""Queries over aggregates, distributions and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.functions.vectors import cosine
from corpuslens.operators import aggregates as A
from corpuslens.operators import relational as R

from .relational import OUTLETS, outlets
from .registry import query


@query("select l_returnflag, l_linestatus, count(*) n, count(*) filter (l_discount > 0.05) discounted, count(distinct l_suppkey) suppliers, cast(sum(cast(l_quantity as bigint)) as bigint) quantity, strftime(min(l_shipdate), '%Y-%m-%d') first_ship, strftime(max(l_shipdate), '%Y-%m-%d') last_ship from lineitem group by all")
def conditional_counts(t):  # A1 A2 A3 A5 A14
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_ship"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_ship"))


@query("select event_type, count(*) n, round(avg(value), 4) mean_value from events group by 1 order by n desc, event_type")
def group_count_sorted(t):  # A4 A6 L1
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value")).orderBy(F.desc("n"), "event_type")


@query("with c as (select c_nationkey, c_mktsegment, count(*) n from customer group by all) select c_nationkey, cast(sum(n) as bigint) total, arg_max(c_mktsegment, (n, c_mktsegment)) dominant from c group by 1")
def dominant_level(t):  # A7
    c = t.customer.groupBy("c_nationkey", "c_mktsegment").count()
    return c.groupBy("c_nationkey").agg(F.sum("count").alias("total"), F.max_by("c_mktsegment", F.struct("count", "c_mktsegment")).alias("dominant"))


@query("select user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') kinds, count(distinct event_type) n from events group by 1")
def distinct_list(t):  # A8 A13
    kinds = F.sort_array(F.collect_set("event_type"))
    return t.events.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"), F.size(kinds).cast("long").alias("n"))


@query("with c as (select source, lang, count(*) n from documents where source is not null and lang is not null group by all) select source, string_agg(concat(lang, '=', n), ',' order by lang) signature from c group by 1")
def geographic_signature(t):  # A9 K12
    m = A.counts_map(t.documents.where("source is not null and lang is not null"), ["source"], "lang")
    return m.select("source", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("signature"))


@query("with c as (select user_id, event_type, count(*) n, min(event_id) f from events group by all) select user_id, event_type, n, rank from (select *, row_number() over (partition by user_id order by n desc, f, event_type) rank from c) where rank <= 2")
def frequency_topk(t):  # A10 A11
    return A.most_common(t.events, ["user_id"], "event_type", "event_id", 2).select("user_id", "event_type", "n", "rank")


@query("with c as (select conv_id, role, min(turn) f from conversations where role <> '' group by all) select conv_id, string_agg(role, '>' order by f, role) roles from c group by 1")
def concat_distinct_positions(t):  # A12
    return A.distinct_in_order(t.conversations, ["conv_id"], "role", "turn").select("conv_id", F.array_join("values", ">").alias("roles"))


@query("with u as (select user_id, sum(case when event_type = 'click' then 1 else 0 end) home, count(*) filter (event_type in ('click', 'view')) total from events group by 1) select round(coalesce(avg(case when total > 0 then home / total end), 0), 6) ratio, count(*) n from u")
def domestic_ratio(t):  # A15
    u = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("home"), F.count_if(F.col("event_type").isin("click", "view")).alias("total"))
    return u.agg(F.round(F.coalesce(F.avg(F.when(F.col("total") > 0, F.col("home") / F.col("total"))), F.lit(0.0)), 6).alias("ratio"), F.count("*").alias("n"))


@query("select event_type, count(value) n, round(avg(value), 6) mean, round(stddev_pop(value), 6) std, round(min(value), 6) least, round(max(value), 6) greatest, round(median(value), 6) median from events group by 1")
def population_summary(t):  # A16 A17
    return t.events.groupBy("event_type").agg(*A.summary("value"))


@query("select event_type, round(quantile_cont(value, 0.025), 6) low, round(quantile_cont(value, 0.975), 6) high from events group by 1")
def percentile_interval(t):  # A18
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("value", F.lit(0.975)), 6).alias("high"))


@query("with q as (select event_type, unnest([0.025, 0.5, 0.975]::double[]) share, unnest(quantile_cont(value, [0.025, 0.5, 0.975])) q, count(value) n from events group by 1) select event_type, share, n, round(q, 6) quantile from q")
def exact_quantiles(t):  # A17 A18: groups of any size
    from corpuslens.operators.quantiles import exact_quantiles as quantiles

    return quantiles(t.events, "event_type", "value", [0.025, 0.5, 0.975]).withColumn("quantile", F.round("quantile", 6))


@query("with x as (select l_discount * 10 v from lineitem), s as (select unnest(range(10)) bin) select bin, coalesce(n, 0) n from s left join (select cast(least(floor(v * 10), 9) as bigint) bin, count(*) n from x where v between 0 and 1 group by 1) using (bin)")
def discount_histogram(t):  # A19
    return A.histogram(t.lineitem.select((F.col("l_discount") * 10).alias("v")), "v").select("bin", F.col("n").cast("long").alias("n"))


@query("select case when l_tax * 10 < 0.2 then 'low' when l_tax * 10 < 0.4 then 'mid' when l_tax * 10 < 0.6 then 'high' else 'top' end bucket, count(*) n, round(avg(cast(l_tax >= 0.05 as int)), 6) share from lineitem group by 1")
def tax_buckets(t):  # A20 A21
    b = A.bucket(F.col("l_tax") * 10, [0.2, 0.4, 0.6], ["low", "mid", "high", "top"])
    return t.lineitem.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(A.share_at_least("l_tax", 0.05), 6).alias("share"))


@query("""with j as (select lang, case when quality = 1 and toxic = 0 then 'agree' when quality <> toxic then 'partial' else 'disagree' end a from labels join documents using (doc_id))
 select coalesce(lang, 'all') lang, count(*) filter (a = 'agree') agree, count(*) filter (a = 'partial') partial, count(*) filter (a = 'disagree') disagree, count(*) filter (a = 'unclear') unclear, round(avg(cast(a in ('agree', 'partial') as int)), 6) rate from j group by grouping sets ((lang), ())""")
def faithfulness_by_language(t):  # A22 A23 M19
    j = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    a = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "agree").when(F.col("quality") != F.col("toxic"), "partial").otherwise("disagree")
    j = j.withColumn("a", a)
    n = [F.count_if(F.col("a") == k).alias(k) for k in ("agree", "partial", "disagree", "unclear")]
    return j.rollup("lang").agg(*n, F.round(F.avg(F.col("a").isin("agree", "partial").cast("int")), 6).alias("rate")).withColumn("lang", F.coalesce("lang", F.lit("all")))


@query("with e as (select role, count(*) n from conversations group by 1) select role, n from e")
def map_column_summary(t):  # A24 C2f
    m = t.conversations.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("#", "role", "turn"), F.lit(1)))).alias("m"))
    return m.select(F.explode("m").alias("k", "v")).groupBy(F.substring_index("k", "#", 1).alias("role")).agg(F.sum("v").alias("n"))


@query("""with c as (select label, i dim, avg(e[i]::double) m from (select label, embedding e, unnest(range(1, 65)) i from embeddings) group by all), v as (select label, list(m order by dim) c from c group by 1)
 select a.label label_a, b.label label_b, round(list_cosine_similarity(a.c, b.c), 5) similarity from v a join v b on a.label < b.label""")
def centroid_similarity(t):  # A25 J17 M1f
    c = A.centroids(t.embeddings, "label", "embedding")
    a, b = c.select(F.col("label").alias("label_a"), F.col("centroid").alias("a")), c.select(F.col("label").alias("label_b"), F.col("centroid").alias("b"))
    return a.join(b, F.col("label_a") < F.col("label_b")).select("label_a", "label_b", F.round(cosine("a", "b"), 5).alias("similarity"))


@query("select c_mktsegment, round(abs(avg(case when c_nationkey < 5 then c_acctbal end) - avg(case when c_nationkey >= 20 then c_acctbal end)), 4) gap from customer group by 1")
def group_mean_gap(t):  # A26 L3
    m = lambda c: F.avg(F.when(c, F.col("c_acctbal")))  # noqa: E731
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.abs(m(F.col("c_nationkey") < 5) - m(F.col("c_nationkey") >= 20)), 4).alias("gap"))


@query("select user_id, round(count(*) filter (event_type = 'error') / greatest(count(*) filter (event_type = 'view'), 1), 6) ratio, case when count(*) filter (event_type = 'signup') = 0 then 'n/a' else 'some' end note from events group by 1")
def guarded_ratio(t):  # A27 M6f
    n = lambda k: F.count_if(F.col("event_type") == k)  # noqa: E731
    return t.events.groupBy("user_id").agg(F.round(A.ratio(n("error"), n("view")), 6).alias("ratio"), F.when(n("signup") == 0, "n/a").otherwise("some").alias("note"))


@query("select count(distinct nullif(trim(lang), '')) languages, count(distinct nullif(trim(source), '')) sources, count(*) documents from documents")
def corpus_distincts(t):  # A28
    return t.documents.agg(F.count_distinct(F.nullif(X.trim("lang"), F.lit(""))).alias("languages"), F.count_distinct(F.nullif(X.trim("source"), F.lit(""))).alias("sources"), F.count("*").alias("documents"))


@query("select 'orders' name, count(*) n from orders union all select 'customer', count(*) from customer union all select 'documents', count(*) from documents union all select 'labels', count(*) from labels union all select 'events', count(*) from events")
def row_count_audit(t):  # A29
    out = None
    for name in ("orders", "customer", "documents", "labels", "events"):
        part = getattr(t, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.select("name", "n")


@query("""select (select count(*) from documents where text is null) = 0 texts_complete, (select count(*) from labels) >= 0.3 * (select count(*) from documents) labels_enough, (select count(*) from labels l anti join documents d using (doc_id)) = 0 labels_known""")
def phase_gates(t):  # A30
    d = t.documents.agg(F.count("*").alias("d"), F.count_if(F.col("text").isNull()).alias("missing"))
    n = t.labels.agg(F.count("*").alias("l"))
    o = t.labels.join(t.documents, "doc_id", "left_anti").agg(F.count("*").alias("o"))
    return d.crossJoin(n).crossJoin(o).select((F.col("missing") == 0).alias("texts_complete"), (F.col("l") >= F.col("d") * 0.3).alias("labels_enough"), (F.col("o") == 0).alias("labels_known"))


@query("with c as (select label, count(*) n from embeddings group by 1) select label, n, round(n / sum(n) over (), 6) share, round(sum(n) over (order by n desc, label rows unbounded preceding) / sum(n) over (), 6) cumulative_share from c")
def cluster_concentration(t):  # W10 M37
    c = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    return R.share_of_total(c, "n", [F.col("n").desc(), "label"]).select("label", "n", F.round("share", 6).alias("share"), F.round("cumulative_share", 6).alias("cumulative_share"))


@query("""with c as (select vec_id % 3 event, label, count(*) n from embeddings group by all), r as (select *, row_number() over (partition by event order by n desc, label) r from c)
 select event, cast(sum(n) as bigint) items, count(*) clusters, round(sum(n) filter (r <= 1) / sum(n), 6) top_1, round(sum(n) filter (r <= 3) / sum(n), 6) top_3, round(sum(n) filter (r <= 5) / sum(n), 6) top_5, count(*) filter (n > 50) "large", count(*) filter (n = 1) singletons from r group by 1""")
def event_concentration(t):  # M37: across events
    c = A.concentration(t.embeddings.select((F.col("vec_id") % 3).alias("event"), "label"), "event", "label")
    return c.select("event", "items", "clusters", *(F.round(k, 6).alias(k) for k in ("top_1", "top_3", "top_5")), "large", "singletons")


_LABEL_STOP = ", ".join(f"'{w}'" for w in A.LABEL_STOP)


@query(rf"""with d as (select source, doc_id, coalesce(lang, '??') l, coalesce(text, '') t, row_number() over (partition by source order by doc_id) k from documents where source is not null),
 g as (select source, l, count(*) n, min(doc_id) f from d group by all), gl as (select source, string_agg(l || '=' || n, ',' order by n desc, f, l) langs from (select *, row_number() over (partition by source order by n desc, f, l) r from g) where r <= 5 group by 1),
 w as (select source, k, list_transform(list_filter(regexp_split_to_array(lower(left(t, 200)), '[ 	

]+'), lambda x: length(x) >= 4), lambda x: trim(x, '.,;:!?"''()[]{{}}|*$%&#')) w from d where k <= 10),
 x as (select source, k, unnest(w) w, generate_subscripts(w, 1) i from w), xc as (select source, w, count(*) n, min(k * 4294967296 + i) f from x where w <> '' and w not in ({_LABEL_STOP}) group by all),
 kw as (select source, string_agg(w, ',' order by n desc, f) keywords from (select *, row_number() over (partition by source order by n desc, f) r from xc) where r <= 5 group by 1)
 select source, count(*) size, round(count(*) / (select count(*) from documents), 6) share, any_value(langs) languages, coalesce(any_value(keywords), '') keywords, left(min(t) filter (k = 1), 100) representative from d join gl using (source) left join kw using (source) group by 1""")
def cluster_composition(t):  # M35 A10
    c = A.composition(t.documents, "source", "doc_id", "lang", "text", noise=None)
    langs = F.array_join(F.transform("top_languages", lambda x: F.concat(x["language"], F.lit("="), x["n"].cast("string"))), ",")
    return c.select("source", "size", F.round("share", 6).alias("share"), langs.alias("languages"), F.array_join("keywords", ",").alias("keywords"), "representative")


@query(f"with {OUTLETS} select o.region, d.lang, count(*) n, round(avg(n_chars), 4) mean_chars from documents d join outlets o on d.source = o.outlet group by cube (o.region, d.lang)")
def region_language_cube(t):  # J12 J24
    d = t.documents.join(outlets(t), F.col("source") == F.col("outlet"))
    return d.cube("region", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("select label, count(*) filter (vec_id % 3 = 0) event_1, count(*) filter (vec_id % 3 = 1) event_2, count(*) filter (vec_id % 3 = 2) event_3 from embeddings group by 1")
def event_crosswalk(t):  # A22 M36
    p = t.embeddings.withColumn("event", F.col("vec_id") % 3).groupBy("label").pivot("event", [0, 1, 2]).count()
    return p.select("label", *(F.coalesce(F.col(str(k)), F.lit(0)).alias(f"event_{k + 1}") for k in range(3)))


@query("select doc_id from documents order by doc_id limit 25")
def limit_prefix(t):  # L7
    return t.documents.orderBy("doc_id").select("doc_id").limit(25)


@query("with c as (select conv_id, count(*) filter (role = 'user') u, count(*) filter (role = 'assistant') a from conversations group by 1) select conv_id, u + a turns from c order by turns desc, conv_id limit 20")
def composite_sort(t):  # L6
    c = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"))
    return c.select("conv_id", (F.col("u") + F.col("a")).alias("turns")).orderBy(F.desc("turns"), "conv_id").limit(20)
