"""Queries over joins, filters, windows, set operations and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import relational as R

from .registry import Tables, query


def outlets(t: Tables) -> DataFrame:
    """The logical source table: outlet, nation, region."""
    s = t.documents.select(F.col("source").alias("outlet")).where("source is not null").distinct()
    s = s.withColumn("n_nationkey", F.expr("cast(substr(outlet, 4) as int) % 25"))
    return s.join(t.nation, "n_nationkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("outlet", F.col("n_name").alias("country"), F.col("r_name").alias("region"))


OUTLETS = """outlets as (select s.outlet, n_name country, r_name region from (select distinct source outlet from documents where source is not null) s
 join nation on n_nationkey = cast(substr(s.outlet, 4) as int) % 25 join region on n_regionkey = r_regionkey)"""


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R' and l_linestatus in ('F', 'X') and l_quantity > 45")
def equality_in_filter(t):  # P11 P15
    return t.lineitem.where((F.col("l_returnflag") == "R") & F.col("l_linestatus").isin("F", "X") & (F.col("l_quantity") > 45)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select p_partkey, p_name from part where p_type like 'PROMO%' and p_name not like '%a%' and lower(p_name) like '%e%'")
def like_filters(t):  # P13 P14
    return t.part.where(F.col("p_type").like("PROMO%") & ~F.col("p_name").like("%a%") & F.col("p_name").ilike("%E%")).select("p_partkey", "p_name")


@query("select doc_id from documents d left join labels l using (doc_id) where (l.toxic is null or l.toxic = 0) and (d.lang is null or d.lang = '' or d.lang <> 'en')")
def missing_or_flag_filter(t):  # P12
    d = t.documents.join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return d.where((F.coalesce("toxic", F.lit(0)) == 0) & (F.coalesce("lang", F.lit("")) != "en")).select("doc_id")


@query("select doc_id, case when length(text) > 100 then concat(left(text, 60), '...') else text end title, length(trim(text)) chars from documents where length(trim(text)) >= 200 and text is not null")
def min_length_and_title(t):  # P17 F16 P8
    d = t.documents.where(F.length(X.trim("text")) >= 200)
    return d.select("doc_id", F.when(F.length("text") > 100, F.concat(F.left("text", F.lit(60)), F.lit("..."))).otherwise(F.col("text")).alias("title"), F.length(X.trim("text")).cast("long").alias("chars"))


@query("select event_id, user_id from events where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-08 00:00:00' and (value is null or value >= 10)")
def interval_filter(t):  # P18 P20 P21
    return t.events.where(F.col("ts").between("2024-01-05 00:00:00", "2024-01-08 00:00:00") & (F.col("value").isNull() | (F.col("value") >= 10))).select("event_id", "user_id")


@query("select event_id from events where user_id % 7 = 0 or ts >= timestamp '2024-01-30 00:00:00' - interval 7 day")
def recency_undated_kept(t):  # P19 X3 X4
    e = t.events.withColumn("dated", F.when(F.col("user_id") % 7 != 0, F.col("ts")))
    return e.where(F.col("dated").isNull() | (F.col("dated") >= F.expr("timestamp'2024-01-30 00:00:00' - interval 7 days"))).select("event_id")


@query(f"with {OUTLETS} select d.doc_id, coalesce(o.country, '??') country, coalesce(d.lang, 'en') lang, cast(coalesce(l.toxic, 0) as bigint) toxic, cast(coalesce(o.region = 'AMERICA', false) as int) home from documents d left join outlets o on o.outlet = d.source left join labels l using (doc_id)")
def left_join_defaults(t):  # J2 J4 P3 P4
    d = t.documents.join(outlets(t), F.col("source") == F.col("outlet"), "left").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    d = d.select("doc_id", "country", "lang", F.col("toxic").cast("long").alias("toxic"), F.coalesce((F.col("region") == "AMERICA").cast("int"), F.lit(0)).alias("home"))
    return R.fill_defaults(d, {"country": "??", "lang": "en", "toxic": 0})


@query("select c_mktsegment, n_name, count(*) orders, cast(round(sum(o_totalprice), 2) as double) total from customer join nation on n_nationkey = c_nationkey join orders on o_custkey = c_custkey where o_orderstatus = 'F' group by all")
def multiway_join(t):  # J1 J3
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.orders.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def semi_join(t):  # J5
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def anti_join(t):  # J6 J7
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by (role = 'assistant') desc, turn desc, text) r from conversations) where r = 1")
def preferred_latest_row(t):  # W1 W2 L4 J25
    return R.first_per_key(t.conversations, ["conv_id"], [(F.col("role") == "assistant").desc(), F.col("turn").desc(), "text"]).select("conv_id", "turn", "role", "text")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn, role, text) r from conversations) where r = 1")
def first_row_per_key(t):  # W3 W11
    return R.first_per_key(t.conversations, ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role")


@query("select event_type, event_id, value, rank from (select *, row_number() over (partition by event_type order by value desc, event_id) rank from events) where rank <= 5")
def top_n_per_group(t):  # L5 W6
    return R.top_per_group(t.events, ["event_type"], [F.col("value").desc(), "event_id"], 5).select("event_type", "event_id", "value", "rank")


@query("select c_custkey, c_acctbal from customer order by abs(c_acctbal) desc, c_custkey limit 15")
def top_abs_gap(t):  # L2 L3
    return t.customer.orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(15).select("c_custkey", "c_acctbal")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 2")
def last_n_of_sequence(t):  # L8
    return R.top_per_group(t.events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 2).select("user_id", "event_id")


@query("""with k as (select n.n_name country, s_suppkey, row_number() over (partition by n.n_name order by s_suppkey) rn from supplier join nation n on n_nationkey = s_nationkey where n.n_name <> 'CHINA'),
 p as (select * from k where rn <= 3 order by rn, country limit 40) select country, s_suppkey, row_number() over (order by rn, country) turn from p""")
def geo_round_robin(t):  # W4
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.when(F.col("n_name") != "CHINA", F.col("n_name")).otherwise("unknown").alias("country"), "s_suppkey")
    return R.round_robin(s, "country", "s_suppkey", 3, 40)


@query("select p_partkey, case when r > 1 then concat(brand, ' (', r, ')') else brand end unique_name from (select p_partkey, p_brand brand, row_number() over (partition by p_brand order by p_partkey) r from part)")
def duplicate_name_suffix(t):  # W7
    return R.suffix_duplicates(t.part, "p_brand", "p_partkey").select("p_partkey", "unique_name")


@query("select p_partkey, cast(floor((row_number() over (partition by p_type order by p_partkey) - 1) / 80) as bigint) chunk from part")
def chunk_assignment(t):  # W8
    return t.part.select("p_partkey", R.chunk_of(["p_partkey"], 80, "p_type").alias("chunk"))


@query("select event_id, cast(floor((row_number() over (order by ts, event_id) - 1) / 80) as bigint) chunk from events")
def global_chunks(t):  # W8: over the whole table
    return R.chunks(t.events.select("event_id", "ts"), ["ts", "event_id"], 80).select("event_id", "chunk")


@query("select pos, event_id from (select event_id, row_number() over (order by ts desc, event_id) - 1 pos from events) where pos % 97 = 5")
def global_positions(t):  # J11: members named by their place in the whole table
    wanted = t.spark.range(t.events.count() + 100).where("id % 97 = 5").withColumnRenamed("id", "pos")
    return R.at_positions(t.events.select("event_id", "ts"), [F.col("ts").desc(), F.col("event_id").asc()], wanted).select("pos", "event_id")


@query("""with s as (select *, sum(case when f then 0 else 1 end) over (partition by user_id order by ts, event_id) i from (select *, event_type = 'click' f from events)),
 k as (select *, sum(cast(f as int)) over (partition by user_id, i order by ts, event_id) streak from s),
 b as (select *, coalesce(max(cast(streak >= 2 as int)) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) cut from k)
 select user_id, event_id, cast(streak as bigint) streak from b where cut = 0""")
def circuit_breaker(t):  # W9 X7
    out = R.circuit_breaker(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "click", 2)
    return out.select("user_id", "event_id", F.col("streak").cast("long").alias("streak"))


@query("""with a as (select s_name, s_acctbal from supplier where s_suppkey % 2 = 0), b as (select s_name, s_acctbal from supplier where s_suppkey % 2 = 1 or s_suppkey % 3 = 0)
 select s_name, max(s_acctbal + x) s_acctbal from (select s_name, s_acctbal, 0 x from a union all select s_name, s_acctbal, 1 from b) group by 1""")
def upsert_greatest(t):  # K6
    a = t.supplier.where("s_suppkey % 2 = 0").select("s_name", "s_acctbal")
    b = t.supplier.where("s_suppkey % 2 = 1 or s_suppkey % 3 = 0").select("s_name", (F.col("s_acctbal") + 1).alias("s_acctbal"))
    return R.upsert_greatest(a, b, ["s_name"], "s_acctbal")


@query("select s_name, case when s_suppkey % 2 = 1 or s_suppkey % 3 = 0 then 'new' else 'old' end origin, s_nationkey from supplier where s_suppkey % 2 = 0 or s_suppkey % 2 = 1 or s_suppkey % 3 = 0")
def upsert_last(t):  # K7
    a = t.supplier.where("s_suppkey % 2 = 0").withColumn("origin", F.lit("old"))
    b = t.supplier.where("s_suppkey % 2 = 1 or s_suppkey % 3 = 0").withColumn("origin", F.lit("new"))
    return R.upsert_last(a, b, ["s_name"], ["origin", "s_nationkey"])


@query("select p_brand, min(p_partkey) p_partkey from part where p_brand not in (select p_brand from part where p_partkey <= 5) group by 1")
def insert_if_absent(t):  # K3 K8 J8 X1 S22
    p = t.part.select("p_brand", "p_partkey")
    return R.insert_if_absent(p.where("p_partkey <= 5"), p, ["p_brand"], ["p_partkey"])


@query("""with d as (select cast(n_nationkey as bigint) id, n_name name from nation where n_nationkey < 10), n as (select distinct n_name name from nation where n_name not in (select name from d))
 select id, name from d union all select (select max(id) from d) + row_number() over (order by name), name from n""")
def dim_get_or_create(t):  # K4
    d = t.nation.where("n_nationkey < 10").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return R.get_or_create(d, t.nation.select(F.col("n_name").alias("name")), "name", "id")


@query("""with k(d) as (values ('example.com'), ('example.net'), ('example.org')) select page_id, min(d) domain from pages join k on contains(lower(url), d) group by 1""")
def dim_by_substring(t):  # K5 J19
    k = t.spark.createDataFrame([("example.com",), ("example.net",), ("example.org",)], "d string")
    return t.pages.join(F.broadcast(k), F.lower("url").contains(F.col("d"))).groupBy("page_id").agg(F.min("d").alias("domain"))


@query("select doc_id, case when lang = 'en' and (doc_id % 4 <> 0) then n_chars else coalesce(nullif(doc_id % 3, 0), 0) end filled from documents")
def conditional_fill(t):  # K9 P2
    cur = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3)
    return t.documents.select("doc_id", F.when((F.col("lang") == "en") & (F.col("doc_id") % 4 != 0), F.col("n_chars")).otherwise(F.coalesce(cur, F.lit(0))).alias("filled"))


@query("""with m as (select s_nationkey, max(s_acctbal) top from supplier group by 1) select n_name, greatest(1000.0::double, coalesce(top, 0)) best, concat(coalesce(n_comment, ''), ' +') notes from (select *, null n_comment from (select n_nationkey, n_name from nation)) left join m on s_nationkey = n_nationkey""")
def conditional_max_update(t):  # K10
    m = t.supplier.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("top"))
    n = t.nation.select("n_nationkey", "n_name").join(m, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return n.select("n_name", F.greatest(F.lit(1000.0), F.coalesce("top", F.lit(0.0))).alias("best"), F.concat(F.coalesce(F.lit(None).cast("string"), F.lit("")), F.lit(" +")).alias("notes"))


@query(f"with {OUTLETS} select n_name country from nation where n_name not in (select country from outlets) and n_regionkey <> 0")
def country_gaps(t):  # K11 U3
    u = t.nation.select(F.col("n_name").alias("country"))
    return R.gaps(u, outlets(t), t.nation.where("n_regionkey = 0").select(F.col("n_name").alias("country")), "country")


WINDOWS = [("w1", 1, "2024-01-02 00:00:00", "2024-01-06 00:00:00"), ("w2", 2, "2024-01-05 00:00:00", "2024-01-11 00:00:00"), ("w3", 3, "2024-01-20 00:00:00", "2024-01-25 00:00:00")]


@query("""with w as (select * from (values ('w1', 1, timestamp '2024-01-02', timestamp '2024-01-06'), ('w2', 2, timestamp '2024-01-05', timestamp '2024-01-11'), ('w3', 3, timestamp '2024-01-20', timestamp '2024-01-25')) v(name, ord, b, e))
 select event_id, arg_min(name, ord) "window" from events join w on ts >= b and ts < e group by 1""")
def window_assignment(t):  # J22 X2
    w = t.spark.createDataFrame(WINDOWS, "window string, ord int, b string, e string").selectExpr("window", "ord", "to_timestamp(b) begins", "to_timestamp(e) ends")
    return R.assign_windows(t.events.select("event_id", "ts"), "ts", w).select("event_id", "window")


_SPANS = "w as (select o_orderkey k, o_orderdate b, o_orderdate + to_hours((1 + o_orderkey % 200)::int) e from orders), d as (select event_id, ts, (date '1992-01-01' + (event_id % 2400)::int)::timestamp + to_minutes((event_id % 1440)::int) spot from events)"


def spans(t):
    """A window an order, some hours long, and the events spread over the orders' years."""
    start = F.col("o_orderdate").cast("timestamp")
    w = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("window"), F.col("o_orderkey").alias("ord"), start.alias("begins"), (start + F.make_interval(hours=(1 + F.col("o_orderkey") % 200).cast("int"))).alias("ends"))
    d = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("event_id") % 2400).cast("int")).cast("timestamp") + F.make_interval(mins=(F.col("event_id") % 1440).cast("int"))
    return t.events.select("event_id", d.alias("spot")), w


@query(f"with {_SPANS} select event_id, 'o' || min(k) \"window\" from d join w on spot >= b and spot < e group by 1")
def interval_first(t):  # J22: as many windows as orders, first listed wins
    d, w = spans(t)
    return R.assign_windows(d, "spot", w, direct=0).select("event_id", "window")


@query(f"with {_SPANS} select k o, count(*) n from d join w on spot >= b and spot < e group by 1")
def interval_counts(t):  # J22 X2: every window of every row
    d, w = spans(t)
    return R.window_counts(d, "spot", w).select(F.substring("window", 2, 20).cast("long").alias("o"), "n")


@query("""with f as (select 0 feed, url, page_id from pages where page_id % 2 = 0 union all select 1, url, page_id from pages)
 select url, page_id from (select *, row_number() over (partition by url order by feed, page_id) r from f) where r = 1""")
def url_first_wins(t):  # U1 S2 W11
    p = t.pages.select("url", "page_id")
    return R.union_by_position([p.where("page_id % 2 = 0"), p], "url", "page_id").select("url", "page_id")


@query("select n_name name, 'nation' kind from nation where n_name in (select r_name from region) or n_nationkey < 3 union all select r_name, 'region' from region where r_name not in (select n_name from nation)")
def union_except(t):  # U2 U3
    n = t.nation.join(t.region, F.col("n_name") == F.col("r_name"), "left").where("r_name is not null or n_nationkey < 3")
    r = t.region.join(t.nation, F.col("n_name") == F.col("r_name"), "left_anti")
    return n.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).unionByName(r.select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


@query("select doc_id from documents where lang = 'en' intersect select doc_id from labels where quality = 1")
def id_intersection(t):  # U4 J16
    return t.documents.where("lang = 'en'").select("doc_id").intersect(t.labels.where("quality = 1").select("doc_id"))


@query("""select coalesce(a.k, b.k) label, case when b.k is null then 'only_a' when a.k is null then 'only_b' else 'both' end side from
 (select distinct label % 7 k from embeddings where vec_id % 2 = 0) a full join (select distinct (label % 7) + 2 k from embeddings where vec_id % 2 = 1) b on a.k = b.k""")
def presence_absence(t):  # U5 U7
    a = t.embeddings.where("vec_id % 2 = 0").select((F.col("label") % 7).alias("ka")).distinct()
    b = t.embeddings.where("vec_id % 2 = 1").select((F.col("label") % 7 + 2).alias("kb")).distinct()
    return a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias("label"), F.when(F.col("kb").isNull(), "only_a").when(F.col("ka").isNull(), "only_b").otherwise("both").alias("side"))


@query("""with c as (select label, list(vec_id order by vec_id) m from embeddings group by 1), x as (select label, unnest(m) id, generate_subscripts(m, 1) - 1 pos from c where true)
 select label, pos, id from x where pos in (0, 2, 5)""")
def positional_members(t):  # J11 P24
    c = t.embeddings.groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("m"))
    wanted = F.array(F.lit(0), F.lit(2), F.lit(5), F.lit(100000))
    return c.select("label", F.explode(wanted).alias("pos"), "m").where("pos < size(m)").select("label", F.col("pos").cast("long").alias("pos"), F.get("m", F.col("pos")).alias("id"))


@query("select doc_id, case lower(lang) when 'en' then 'English' when 'de' then 'German' when 'fr' then 'French' when 'es' then 'Spanish' else lower(lang) end language from documents")
def dictionary_lookup(t):  # J9 J10 S27
    m = F.create_map(*(F.lit(x) for x in ("en", "English", "de", "German", "fr", "French", "es", "Spanish")))
    return t.documents.select("doc_id", F.coalesce(F.try_element_at(m, F.lower("lang")), F.lower("lang")).alias("language"))


@query("""select doc_id, source outlet, event, prev_kind from (select doc_id, source, doc_id % 3 + 1 event, last_value(case when doc_id % 10 = 0 then lang end ignore nulls) over (partition by source order by doc_id rows between unbounded preceding and current row) prev_kind from documents)""")
def carry_forward(t):  # W13
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    d = t.documents.withColumn("prev_kind", F.last(F.when(F.col("doc_id") % 10 == 0, F.col("lang")), True).over(w))
    return d.select("doc_id", F.col("source").alias("outlet"), (F.col("doc_id") % 3 + 1).alias("event"), "prev_kind")


@query("select label, max(vec_id) vec_id from embeddings group by 1")
def latest_per_label(t):  # W5 W12
    return R.first_per_key(t.embeddings, ["label"], [F.col("vec_id").desc()]).select("label", "vec_id")


@query("with f as (select vec_id, embedding from embeddings where label = 0) select count(*) n, round(avg(len(embedding)), 2) dims from f")
def table_scan_count(t):  # S4 K13
    return t.embeddings.where("label = 0").agg(F.count("*").alias("n"), F.round(F.avg(F.size("embedding")), 2).alias("dims"))
