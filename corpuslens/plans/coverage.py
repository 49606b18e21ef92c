"""Queries over coverage, absence, entities and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import coverage as C
from corpuslens.operators import sampling as S
from corpuslens.operators.lexicon import match_terms

from .registry import query
from .relational import OUTLETS, outlets


@query(f"with {OUTLETS}, g as (select r_name region, n_name country from nation join region on r_regionkey = n_regionkey union all select 'EXTRA', n_name from nation where n_nationkey % 5 = 0), j as (select region, country in (select country from outlets) hit from g) select region, count(*) filter (hit) present, count(*) filter (not hit) absent, round(count(*) filter (hit) / count(*), 6) ratio from j group by 1 having count(*) filter (not hit) > 0")
def region_coverage_ratio(t):  # M34
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    g = n.select(F.col("r_name").alias("region"), F.col("n_name").alias("country")).unionByName(t.nation.where("n_nationkey % 5 = 0").select(F.lit("EXTRA").alias("region"), F.col("n_name").alias("country")))
    return C.absence_report(g, outlets(t)).withColumn("ratio", F.round("ratio", 6))


@query("select lang language from (values ('en'), ('fr'), ('de'), ('es'), ('ru'), ('fa'), ('zh')) v(lang) where lang not in (select lang from documents where lang is not null)")
def missing_languages(t):  # U3 M33
    u = t.spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "ru", "fa", "zh")], "language string")
    return u.join(t.documents.select(F.col("lang").alias("language")), "language", "left_anti")


@query(f"with {OUTLETS}, d as (select * from documents join outlets on outlet = source) select 'region' dimension, region \"value\", count(*) n from d group by 2 union all select 'language', lang, count(*) from d group by 2 union all select 'source', source, count(*) from d group by 2 union all select 'country', country, count(*) from d group by 2")
def coverage_report(t):  # M33 M36
    d = t.documents.join(outlets(t), F.col("source") == F.col("outlet"))
    out = C.distribution(d, "region", "region")
    for column, name in (("lang", "language"), ("source", "source"), ("country", "country")):
        out = out.unionByName(C.distribution(d, column, name))
    return out


@query("with k(name) as (values ('idiot'), ('clown'), ('haha'), ('onthe'), ('keit'), ('nowhere')), m as (select name, doc_id, source from documents join k on contains(lower(text), name)), a as (select name, count(*) docs, count(*) filter (source = 'src1') media from m group by 1) select name, docs, media, round(media / greatest(docs, 1), 6) ratio, case when docs >= 10 and media = 0 then 'SUPPRESSED' when docs >= 10 and media / greatest(docs, 1) < 0.2 then 'UNDER-COVERED' else '' end status from a")
def suppression_index(t):  # M38 M39 J19 J23
    k = t.spark.createDataFrame([(x,) for x in ("idiot", "clown", "haha", "onthe", "keit", "nowhere")], "name string")
    held = match_terms(t.documents.select("doc_id", "source", "text"), F.col("text"), k.select(F.col("name").alias("term"), "name"))
    m = held.select("source", F.explode("found.name").alias("name"))
    docs, media = m.groupBy("name").agg(F.count("*").alias("docs")), m.where("source = 'src1'").groupBy("name").agg(F.count("*").alias("media"))
    return C.suppression(docs, media).withColumn("ratio", F.round("ratio", 6))


@query("select user_id, count(*) contexts, count(*) filter (event_type = 'purchase') money, count(*) filter (ts > timestamp '2024-01-15') later, arg_max(event_type, (n, event_type)) dominant from (select *, count(*) over (partition by user_id, event_type) n from events) group by 1")
def involvement_status(t):  # M40 A7
    per = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") > F.expr("timestamp'2024-01-15 00:00:00'")).alias("late"))
    return per.groupBy("user_id").agg(F.sum("n").alias("contexts"), F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("n"))), F.lit(0)).alias("money"), F.sum("late").alias("later"), F.max_by("event_type", F.struct("n", "event_type")).alias("dominant"))


@query("with c as (select (select count(*) from documents) total, (select count(*) from documents where text <> '') texts, (select count(*) from labels) analysed, (select count(*) from labels where quality = 1) judged) select *, case when total = 0 then 'ingest' when texts / total < 0.5 then 'extract' when analysed / texts < 0.9 then 'analyze' when judged / analysed < 0.9 then 'council' else 'cluster' end next_phase from c")
def phase_status(t):  # M41
    d = t.documents.agg(F.count("*").alias("total"), F.count_if(F.col("text") != "").alias("texts"))
    return C.next_phase(d.crossJoin(t.labels.agg(F.count("*").alias("analysed"), F.count_if(F.col("quality") == 1).alias("judged"))))


@query("select label, count(*) articles, count(*) filter (vec_id % 3 = 0) high, count(*) filter (vec_id % 3 = 1) medium, count(*) filter (vec_id % 3 = 2) contested from embeddings group by 1 having count(*) > 1")
def cluster_report(t):  # M42 P22
    v = F.col("vec_id") % 3
    return t.embeddings.groupBy("label").agg(F.count("*").alias("articles"), *(F.count_if(v == k).alias(n) for k, n in enumerate(("high", "medium", "contested")))).where("articles > 1")


@query("with a as (select vec_id item, label cluster from embeddings), m as (select item, cluster % 3 merged from a where cluster % 4 <> 3) select item, merged, false carried from m union all select item, cluster + 100, true from a where item not in (select item from m)")
def coverage_preserving_merge(t):  # M43 J7
    a = t.embeddings.select(F.col("vec_id").alias("item"), F.col("label").alias("cluster"))
    m = a.where("cluster % 4 <> 3").select("item", (F.col("cluster") % 3).alias("merged"), F.lit(False).alias("carried"))
    return m.unionByName(a.join(m, "item", "left_anti").select("item", (F.col("cluster") + 100).alias("merged"), F.lit(True).alias("carried")))


@query("with r as (select doc_id, lang, unnest(case when toxic = 1 then ['alarm', 'anger'] else ['calm'] end) register from labels join documents using (doc_id)) select register, coalesce(lang, '??') lang, count(*) n from r group by all")
def register_distribution(t):  # M44
    r = t.labels.join(t.documents, "doc_id").select("lang", F.explode(F.when(F.col("toxic") == 1, F.array(F.lit("alarm"), F.lit("anger"))).otherwise(F.array(F.lit("calm")))).alias("register"))
    return r.groupBy("register", F.coalesce("lang", F.lit("??")).alias("lang")).agg(F.count("*").alias("n"))


@query("with p as (select conv_id, role, left(text, 40) sample, row_number() over (partition by conv_id order by turn, text) r, count(*) over (partition by conv_id) n from conversations) select conv_id, n, string_agg(sample, '|' order by r) samples from p where r <= 3 group by all")
def presupposition_summary(t):  # M45 L5
    from corpuslens.operators.relational import top_per_group

    n = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    top = top_per_group(t.conversations, ["conv_id"], ["turn", "text"], 3).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.left("text", F.lit(40)).alias("s")))).alias("s"))
    return n.join(top, "conv_id").select("conv_id", "n", F.array_join(F.transform("s", lambda x: x["s"]), "|").alias("samples"))


@query("select label, count(*) filter (vec_id % 6 = 0) tensions, round(avg(cast(vec_id % 6 = 0 as int)), 6) prevalence, label >= 7 novel from embeddings group by label")
def tension_prevalence(t):  # M46
    x = (F.col("vec_id") % 6) == 0
    return t.embeddings.groupBy("label").agg(F.count_if(x).alias("tensions"), F.round(F.avg(x.cast("int")), 6).alias("prevalence")).withColumn("novel", F.col("label") >= 7)


@query("with w as (select doc_id, unnest(string_split(text, chr(10))) claim, generate_subscripts(string_split(text, chr(10)), 1) pos from documents where text is not null), f as (select claim, min((doc_id is null, doc_id, pos)) f from w where claim <> '' group by 1) select claim from f order by f limit 40")
def claims_list(t):  # M47
    w = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "claim")).where("claim <> ''")
    return w.groupBy("claim").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos")).alias("f")).orderBy("f").limit(40).select("claim")


@query("select event, total, round(rate, 6) rate, case when rate >= 0.6 then 'transfers' when rate >= 0.4 then 'partial' else 'fails' end band from (select vec_id % 3 event, count(*) total, avg(cast(label in (1, 2, 3, 4, 5) as int)) rate from embeddings group by 1)")
def preregistration_score(t):  # M49
    g = t.embeddings.groupBy((F.col("vec_id") % 3).alias("event")).agg(F.count("*").alias("total"), F.avg(F.col("label").isin(1, 2, 3, 4, 5).cast("int")).alias("rate"))
    return g.select("event", "total", F.round("rate", 6).alias("rate"), F.when(F.col("rate") >= 0.6, "transfers").when(F.col("rate") >= 0.4, "partial").otherwise("fails").alias("band"))


FRAMES = [("insult", "idiot"), ("insult", "clown"), ("french", "eaux"), ("german", "keit"), ("english", "thand")]


@query("with f(frame, term) as (values ('insult', 'idiot'), ('insult', 'clown'), ('french', 'eaux'), ('german', 'keit'), ('english', 'thand')), h as (select distinct frame, doc_id from documents join f on contains(lower(text), term)) select frame, count(*) n, round(count(*) / (select count(*) from documents), 6) share from h group by 1")
def absent_frame_share(t):  # M50
    return C.frame_share(t.documents, t.spark.createDataFrame(FRAMES, "frame string, term string"), t.documents.count()).withColumn("share", F.round("share", 6))


@query("with d as (select contains(lower(text), 'keit') a, contains(lower(text), 'lich') b from documents) select count(*) filter (a) mention, count(*) filter (a and b) \"both\", round(count(*) filter (a and b) / greatest(count(*) filter (a), 1), 6) share from d")
def nested_frame_share(t):  # M50
    a, b = F.lower("text").contains("keit"), F.lower("text").contains("lich")
    return t.documents.agg(F.count_if(a).alias("mention"), F.count_if(a & b).alias("both"), F.round(F.count_if(a & b) / F.greatest(F.count_if(a), F.lit(1)), 6).alias("share"))


@query("with f as (select unnest(string_split(text, ' ')) flag from conversations where role = 'user') select flag, count(*) n from f where flag <> '' group by 1 order by n desc, flag limit 10")
def absence_flag_leaderboard(t):  # M51
    f = t.conversations.where("role = 'user'").select(F.explode(F.split("text", " ")).alias("flag")).where("flag <> ''")
    return f.groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag").limit(10)


@query("with g as (select user_id, event_type, count(*) n, string_agg(event_id::varchar, ',' order by event_id) filter (r <= 2) samples from (select *, row_number() over (partition by user_id, event_type order by event_id) r from events) group by all) select user_id, event_type, n, samples, case when n / 10 >= 2 then 'AMPLIFIED' else '' end mark from g")
def entity_dossier(t):  # M52
    from corpuslens.operators.relational import top_per_group

    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    s = top_per_group(t.events, ["user_id", "event_type"], ["event_id"], 2).groupBy("user_id", "event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("samples"))
    return n.join(s, ["user_id", "event_type"]).withColumn("mark", C.amplified(F.col("n") / 10))


@query("with n as (select lang, count(*) n from documents where lang is not null group by 1), q as (select lang, cast(least(greatest(round_even(n / (select sum(n) from n) * 60, 0), 1), n) as bigint) q from n), r as (select doc_id, lang, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) r from documents where lang is not null) select doc_id, lang from r join q using (lang) where r <= q")
def stratified_sample(t):  # M6 D12
    return S.stratified(t.documents.where("lang is not null").select("doc_id", "lang"), "lang", "doc_id", 60)


@query("with n as (select o_custkey, count(*) n from orders group by 1), q as (select o_custkey, cast(least(greatest(round_even(n / (select sum(n) from n) * 40, 0), 1), n) as bigint) q from n), r as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by md5('42:' || o_orderkey), o_orderkey) r from orders) select o_orderkey, o_custkey from r join q using (o_custkey) where r <= q order by md5('trim:42:' || o_orderkey), o_orderkey limit 40")
def trimmed_sample(t):  # M6: many small strata
    return S.stratified(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 40)


@query("""with d as (select doc_id, lang, case doc_id % 3 when 0 then 'contested' when 1 then 'medium' else 'high' end "level", md5('42:' || doc_id) h from documents),
 c as (select *, 0 tier from d where "level" = 'contested' order by h, doc_id limit 24), m as (select *, 1 tier from d where "level" = 'medium' order by h, doc_id limit 18), t as (select * from c union all select * from m),
 r as (select *, 2 tier from d where doc_id not in (select doc_id from t) order by h, doc_id limit 60), k as (select * from (select * from t union all select * from r) order by tier, h, doc_id limit 60),
 n as (select greatest(ceil(count(*) * 0.3) - count(*) filter (lang <> 'en'), 0) need from k), i as (select *, row_number() over (order by h, doc_id) j from d where doc_id not in (select doc_id from k) and lang <> 'en'),
 i2 as (select doc_id, lang, "level" from i, n where j <= least(need, 60)), o as (select *, row_number() over (order by tier desc, h desc, doc_id) j from k where not (lang <> 'en')),
 o2 as (select doc_id from o where j <= (select count(*) from i2)) select doc_id, lang, "level" from k where doc_id not in (select doc_id from o2) union all select * from i2""")
def priority_sample(t):  # M7
    d = t.documents.select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, "contested").when(F.col("doc_id") % 3 == 1, "medium").otherwise("high").alias("level"))
    return S.priority(d, "doc_id", "level", "lang", 60)


ENTITIES = [(0, "Ada Keitle", ["thand", "ofthe"]), (1, "Bo Church", ["idiot"]), (2, "Cy Tionat", ["onthe", "thand"]), (3, "Solo", []), (4, "Dee Reaux", None)]
TERMS = "k(term, name) as (values ('ada keitle', 'Ada Keitle'), ('ofthe', 'Ada Keitle'), ('keitle', 'Ada Keitle'), ('bo church', 'Bo Church'), ('idiot', 'Bo Church'), ('cy tionat', 'Cy Tionat'), ('onthe', 'Cy Tionat'), ('thand', 'Cy Tionat'), ('tionat', 'Cy Tionat'), ('solo', 'Solo'), ('dee reaux', 'Dee Reaux'))"


def tagged(t):
    e = t.spark.createDataFrame(ENTITIES, "ord int, name string, aliases array<string>")
    return C.tag_entities(t.documents.select("doc_id", "lang", "text"), C.entity_terms(e), F.concat_ws(" ", F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))), ["schich", "ement"])


@query(f"with {TERMS}, d as (select doc_id, lower(concat_ws(' ', coalesce(lang, ''), coalesce(text, ''))) x from documents), m as (select doc_id, string_agg(distinct name, ',' order by name) names from d join k on contains(x, term) group by 1) select d.doc_id, coalesce(names, '') entities, contains(x, 'schich') or contains(x, 'ement') angle from d left join m using (doc_id) where names is not null or contains(x, 'schich') or contains(x, 'ement')")
def entity_tags(t):  # J19 M39
    return tagged(t).select("doc_id", F.array_join("entities", ",").alias("entities"), "angle")


@query("""with k as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) term from benchmark), d as (select doc_id, lower(text) x from documents)
 select doc_id, count(*) terms, min(term) first_term, max(term) last_term from d join k on contains(x, term) group by 1""")
def lexicon_matches(t):  # J19: every word of the benchmark, in any text
    k = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term")).distinct()
    held = match_terms(t.documents.select("doc_id", "text"), F.col("text"), k.select("term", F.col("term").alias("name")))
    found = F.col("found.term")
    return held.where(F.size("found") > 0).select("doc_id", F.size("found").cast("long").alias("terms"), F.array_min(found).alias("first_term"), F.array_max(found).alias("last_term"))


@query(f"with {TERMS}, d as (select doc_id, lower(concat_ws(' ', coalesce(lang, ''), coalesce(text, ''))) x from documents) select name, count(distinct doc_id) media from d join k on contains(x, term) group by 1")
def entity_media_counts(t):  # M39
    return C.entity_counts(tagged(t), "doc_id")


@query("with d as (select lower(text) x from documents) select count(*) filter (contains(x, 'keit') or contains(x, 'lich')) left_docs, count(*) filter (contains(x, 'eaux')) right_docs, round(count(*) filter (contains(x, 'keit') or contains(x, 'lich')) / nullif(count(*) filter (contains(x, 'eaux')), 0), 6) ratio from d")
def frame_set_ratio(t):  # M50
    return C.frame_ratio(t.documents, F.col("text"), ["keit", "lich"], ["eaux"]).withColumn("ratio", F.round("ratio", 6))


@query("with f(frame, term) as (values ('insult', 'idiot'), ('insult', 'clown'), ('french', 'eaux'), ('german', 'keit'), ('english', 'thand'), ('never', 'zzzqqq')), h as (select distinct frame, doc_id from documents join f on contains(lower(text), term)), s as (select frame, count(*) n, round(count(*) / (select count(*) from documents), 6) share from h group by 1), e as (select frame, coalesce(n, 0) n, coalesce(share, 0) share from (select distinct frame from f) left join s using (frame)) select row_number() over (order by n, frame) rank, frame, n, share, (select median(share) from e) median_share from e")
def frame_ranking(t):  # M50
    frames = t.spark.createDataFrame([*FRAMES, ("never", "zzzqqq")], "frame string, term string")
    return C.frame_summary(C.frame_share(t.documents, frames, t.documents.count()).withColumn("share", F.round("share", 6)), frames)


@query("""with c as (select user_id entity, event_type "level", event_id ord, cast(json_extract_string(props, '$.k') as varchar) detail, case when event_type = 'purchase' then 'm' || cast(round(value) as bigint) else '' end money, case when event_type = 'error' then 'c' || event_id % 4 else '' end consequences from events),
 n as (select entity, "level", count(*) n from c group by all), s as (select entity, "level", string_agg(detail, '/' order by ord) samples from (select *, row_number() over (partition by entity, "level" order by ord) r from c) where r <= 3 group by all),
 l as (select entity, cast(sum(n) as bigint) contexts, string_agg("level" || ':' || n || ':' || samples, ';' order by n desc, "level") levels from n join s using (entity, "level") group by 1),
 m as (select entity, string_agg(money, ',' order by f) money from (select entity, money, min(ord) f from c where money <> '' group by 1, 2) group by 1), q as (select entity, string_agg(consequences, ',' order by f) consequences from (select entity, consequences, min(ord) f from c where consequences <> '' group by 1, 2) group by 1)
 select entity, contexts, levels, coalesce(money, '') money, coalesce(consequences, '') consequences from l left join m using (entity) left join q using (entity)""")
def entity_dossier_lists(t):  # M52
    kind = lambda k, v: F.when(F.col("event_type") == k, v).otherwise("")
    money, hurt = F.concat(F.lit("m"), F.round("value").cast("long").cast("string")), F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string"))
    c = t.events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("level"), F.col("event_id").alias("ord"), F.get_json_object("props", "$.k").alias("detail"), kind("purchase", money).alias("money"), kind("error", hurt).alias("consequences"))
    d = C.dossier(c, ["money", "consequences"])
    levels = F.array_join(F.transform("levels", lambda x: F.concat_ws(":", x["level"], x["n"].cast("string"), F.array_join(x["samples"], "/"))), ";")
    return d.select("entity", "contexts", levels.alias("levels"), F.array_join("money", ",").alias("money"), F.array_join("consequences", ",").alias("consequences"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def resume_pending(t):  # X6
    from corpuslens.operators.relational import remaining

    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return remaining(t.orders.select("o_orderkey"), done, ["o_orderkey"])
