"""Queries over model readings, labelings, annotators and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import aggregates as A
from corpuslens.operators import agreement as G
from corpuslens.operators import clustering as C
from corpuslens.operators import consensus as K

from .registry import Tables, query


def readings(t: Tables) -> DataFrame:
    """Three perturbed readings of each embedded article."""
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    n = t.embeddings.count()
    step = lambda k: e.select(F.pmod(F.col("vec_id") - k + n, F.lit(n)).alias("vec_id"), F.col("e").alias(f"e{k}"))
    j = e.join(step(1), "vec_id").join(step(2), "vec_id")
    i = F.col("vec_id")
    mix = lambda k, w: F.zip_with("e", f"e{k}", lambda a, b: a + w * 0.4 * b)
    parts = [
        j.select(i.alias("article_id"), F.lit(0).alias("ord"), F.lit("m0").alias("model"), F.col("e").alias("vector"), (i % 3).cast("double").alias("confidence")),
        j.where(i % 97 != 0).select(i.alias("article_id"), F.lit(1).alias("ord"), F.lit("m1").alias("model"), mix(1, i % 5).alias("vector"), (i % 4).cast("double").alias("confidence")),
        j.where(i % 17 != 0).select(i.alias("article_id"), F.lit(2).alias("ord"), F.lit("m2").alias("model"), mix(2, F.floor(i / 5) % 5).alias("vector"), (i % 5).cast("double").alias("confidence")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("article_id % 211 <> 1")


READINGS = """e as (select vec_id i, embedding::double[] e from embeddings), n as (select count(*) n from embeddings), j as (select a.i, a.e, b.e e1, c.e e2 from e a, n, e b, e c where b.i = (a.i + 1) % n.n and c.i = (a.i + 2) % n.n),
 r as (select i article_id, 0 ord, 'm0' model, e vector, cast(i % 3 as double) confidence from j where i % 211 <> 1
 union all select i, 1, 'm1', list_transform(list_zip(e, e1), lambda x: x[1] + (i % 5) * 0.4 * x[2]), i % 4 from j where i % 97 <> 0 and i % 211 <> 1
 union all select i, 2, 'm2', list_transform(list_zip(e, e2), lambda x: x[1] + ((i // 5) % 5) * 0.4 * x[2]), i % 5 from j where i % 17 <> 0 and i % 211 <> 1),
 p as (select a.article_id, a.ord oa, b.ord ob, a.model ma, b.model mb, a.confidence ca, b.confidence cb, list_cosine_similarity(a.vector, b.vector) s from r a join r b on a.article_id = b.article_id and a.ord < b.ord)"""

COUNCIL = READINGS + """, c as (select article_id, count(*) n, arg_max(model, (confidence, -ord)) boldest from r group by 1),
 q as (select article_id, bool_and(s >= 0.82) every_, bool_or(s >= 0.82) near, arg_min(case when cb > ca then mb else ma end, (oa, ob)) filter (s >= 0.82) speaker, arg_min(3 - oa - ob, (oa, ob)) filter (s >= 0.82) rest from p group by 1),
 v as (select e.i article_id, coalesce(n, 0) n_valid, case when coalesce(n, 0) = 0 then 'failed' when n = 1 then 'low' when n >= 3 and every_ then 'high' when n >= 3 and near then 'medium' else 'contested' end level, boldest, speaker, rest from e left join c on c.article_id = e.i left join q on q.article_id = e.i),
 w as (select article_id, n_valid, level, case level when 'high' then boldest when 'low' then boldest when 'medium' then speaker end consensus_model, case when level = 'medium' then 'm' || rest end dissenter from v)"""


@query(f"with {COUNCIL} select * from w")
def council_consensus(t):  # M1 J13
    return K.council(t.embeddings.select(F.col("vec_id").alias("article_id")), readings(t))


@query(f"with {COUNCIL} select level, count(*) n from w group by 1")
def council_distribution(t):  # M1 A4
    return council_consensus(t).groupBy("level").agg(F.count("*").alias("n"))


@query(f"with {COUNCIL} select article_id, consensus_model model, false needs_review from w where level in ('high', 'medium') union all select w.article_id, r.model, true from w join r using (article_id) where level = 'contested'")
def verdict_fan_out(t):  # M2
    return K.verdict_rows(council_consensus(t), readings(t))


@query(f"with {READINGS} select article_id, round(avg(s), 6) mean, round(min(s), 6) least, case when avg(cast(s >= 0.75 as int)) = 1 then 'high' when avg(cast(s >= 0.75 as int)) >= 0.5 then 'medium' else 'contested' end level from p group by 1")
def semantic_divergence_article(t):  # M3
    d = K.semantic_divergence(K.reading_pairs(readings(t)))
    return d.select("article_id", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"), "level")


@query(f"with {READINGS}, d as (select article_id, avg(s) mean, case when avg(cast(s >= 0.75 as int)) = 1 then 'high' when avg(cast(s >= 0.75 as int)) >= 0.5 then 'medium' else 'contested' end level from p group by 1) select lang, count(*) total, count(*) filter (level = 'high') high, count(*) filter (level = 'medium') medium, count(*) filter (level = 'contested') contested, round(avg(cast(level = 'contested' as int)), 6) rate, round(avg(mean), 5) mean from d join documents on doc_id = article_id group by 1")
def semantic_divergence_by_language(t):  # M3 M4 A22
    d = K.semantic_divergence(K.reading_pairs(readings(t))).join(t.documents.select(F.col("doc_id").alias("article_id"), "lang"), "article_id")
    n = [F.count_if(F.col("level") == k).alias(k) for k in ("high", "medium", "contested")]
    return d.groupBy("lang").agg(F.count("*").alias("total"), *n, F.round(F.avg((F.col("level") == "contested").cast("int")), 6).alias("rate"), F.round(F.avg("mean"), 5).alias("mean"))


@query(f"with {READINGS} select ma || '-' || mb pair, count(*) n, round(avg(s), 5) mean, round(stddev_pop(s), 5) std, count(*) filter (s < 0.82) disagreements from p group by 1")
def semantic_divergence_model_pairs(t):  # M3 M4
    p = K.reading_pairs(readings(t))
    return p.groupBy(F.concat_ws("-", "model_a", "model_b").alias("pair")).agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 5).alias("mean"), F.round(F.stddev_pop("similarity"), 5).alias("std"), F.count_if(F.col("similarity") < 0.82).alias("disagreements"))


@query(f"with {READINGS}, h as (select cast(least(floor(round(s, 9) * 10), 9) as bigint) bin, count(*) n from p where round(s, 9) between 0 and 1 group by 1) select bin, coalesce(n, 0) n from (select unnest(range(10)) bin) left join h using (bin)")
def similarity_histogram(t):  # A19
    p = K.reading_pairs(readings(t)).select(F.round("similarity", 9).alias("similarity"))
    return A.histogram(p, "similarity").select("bin", F.col("n").cast("long").alias("n"))


@query(f"with {READINGS} select e.i article_id, case when s >= 0.82 then 'high' when s >= 0.65 then 'medium' else 'contested' end band from e left join (select article_id, s from p where oa = 0 and ob = 1) x on x.article_id = e.i")
def sample_comparison(t):  # M5
    p = K.reading_pairs(readings(t)).where("ord_a = 0 and ord_b = 1").select("article_id", "similarity")
    s = t.embeddings.select(F.col("vec_id").alias("article_id")).join(p, "article_id", "left")
    return s.select("article_id", K.banded(F.coalesce("similarity", F.lit(0.0))).alias("band"))


def labelings(t: Tables) -> DataFrame:
    e = t.embeddings
    i, l = F.col("vec_id"), F.col("label")
    a = e.select(F.lit("a").alias("run"), i.alias("item"), l.cast("long").alias("label"))
    b = e.select(F.lit("b").alias("run"), i.alias("item"), F.when(i % 4 == 0, (l + 1) % 10).otherwise(l).cast("long").alias("label"))
    c = e.select(F.lit("c").alias("run"), i.alias("item"), (i % 7).cast("long").alias("label"))
    return a.unionByName(b).unionByName(c)


RUNS = "m as (select 'a' run, vec_id item, cast(label as bigint) label from embeddings union all select 'b', vec_id, case when vec_id % 4 = 0 then (label + 1) % 10 else label end from embeddings union all select 'c', vec_id, vec_id % 7 from embeddings)"


@query(f"""with {RUNS}, c as (select x.run run_a, y.run run_b, x.label la, y.label lb, count(*) n from m x join m y on x.item = y.item and x.run < y.run group by all),
 r as (select run_a, run_b, sum(x * (x - 1) / 2) sa, sum(x * ln(x)) ha from (select run_a, run_b, la, sum(n) x from c group by all) group by all), k as (select run_a, run_b, sum(x * (x - 1) / 2) sb, sum(x * ln(x)) hb from (select run_a, run_b, lb, sum(n) x from c group by all) group by all),
 z as (select run_a, run_b, cast(sum(n) as bigint) common, sum(n * (n - 1) / 2) sab, sum(n * ln(n)) hab from c group by all)
 select run_a, run_b, common, round((sab - sa * sb / (common * (common - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (common * (common - 1) / 2)), 6) ari, round((common * ln(common) - ha - hb + hab) / ((2 * common * ln(common) - ha - hb) / 2), 6) nmi from z join r using (run_a, run_b) join k using (run_a, run_b)""")
def cluster_run_agreement(t):  # M8 M9 J14
    a = G.run_agreement(labelings(t))
    return a.select("run_a", "run_b", "common", F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


@query(f"""with {RUNS}, c as (select x.run run_a, y.run run_b, x.label la, y.label lb, count(*) n from m x join m y on x.item = y.item and x.run < y.run group by all),
 r as (select run_a, run_b, sum(x * (x - 1) / 2) sa from (select run_a, run_b, la, sum(n) x from c group by all) group by all), k as (select run_a, run_b, sum(x * (x - 1) / 2) sb from (select run_a, run_b, lb, sum(n) x from c group by all) group by all),
 z as (select run_a, run_b, cast(sum(n) as bigint) common, sum(n * (n - 1) / 2) sab from c group by all), a as (select (sab - sa * sb / (common * (common - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (common * (common - 1) / 2)) ari from z join r using (run_a, run_b) join k using (run_a, run_b))
 select count(*) n, round(avg(ari), 6) mean, round(stddev_pop(ari), 6) std, round(min(ari), 6) least, round(max(ari), 6) greatest, round(median(ari), 6) median, case when avg(ari) > 0.6 then 'strong' when avg(ari) > 0.3 then 'moderate' else 'weak' end wording from a""")
def run_agreement_summary(t):  # M10
    return G.run_agreement(labelings(t)).agg(*A.summary("ari")).withColumn("wording", G.agreement_wording(F.col("mean")))


@query(f"with {RUNS}, c as (select x.label, y.label dest, count(*) n from m x join m y on x.item = y.item where x.run = 'a' and y.run = 'b' group by all) select label, cast(sum(n) as bigint) common, arg_max(dest, (n, -dest)) destination, round(max(n) / sum(n), 6) share, max(n) / sum(n) >= 0.5 stable from c group by 1")
def per_cluster_stability(t):  # M11
    r = labelings(t)
    s = G.cluster_stability(r.where("run = 'a'"), r.where("run = 'b'"))
    return s.select("label", "common", "destination", F.round("share", 6).alias("share"), "stable")


def bootstrap_runs(t: Tables) -> DataFrame:
    """Six 80 % subsamples with a few moved labels."""
    e = t.embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("run"))
    return e.where("(vec_id * 7 + run * 13) % 5 <> 0").select("run", F.col("vec_id").alias("item"), F.when((F.col("vec_id") + F.col("run")) % 9 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


RATES = """b as (select run, vec_id item, case when (vec_id + run) % 9 = 0 then (label + 1) % 10 else label end label from embeddings, (select unnest(range(6)) run) where (vec_id * 7 + run * 13) % 5 <> 0),
 w as (select b.*, e.label cluster from b join embeddings e on vec_id = item), pr as (select x.cluster, x.item i, y.item j, count(*) sampled, count(*) filter (x.label = y.label) together from w x join w y on x.run = y.run and x.cluster = y.cluster and x.item < y.item group by all)"""


@query(f"with {RATES} select cast(cluster as bigint) cluster, i, j, sampled, together, round(together / sampled, 6) rate from pr")
def cooccurrence_rates(t):  # M12 J18
    r = G.cooccurrence(t.embeddings.select(F.col("vec_id").alias("item"), F.col("label").cast("long").alias("label")), bootstrap_runs(t), digits=6)
    return r.select("cluster", "i", "j", "sampled", "together", "rate")


@query(f"""with {RATES.split(',\n w as')[0]}, pr as (select x.item i, y.item j, count(*) filter (x.label = y.label) / count(*) r from b x join b y on x.run = y.run and x.item < y.item group by all)
 select count(*) pairs, round(avg(r), 6) mean, round(stddev_pop(r), 6) std, round(median(r), 6) median from pr where r > 0""")
def cooccurrence_summary(t):  # M12: the whole matrix
    return G.cooccurrence_statistics(bootstrap_runs(t)).select("pairs", *(F.round(c, 6).alias(c) for c in ("mean", "std", "median")))


@query(f"with {RATES}, q as (select cluster, i item, together / sampled r from pr union all select cluster, j, together / sampled from pr), mm as (select cluster, item, avg(r) m from q group by all) select cast(cluster as bigint) cluster, n, round(mean_rate, 6) mean_rate, core from (select cluster, count(*) n, count(*) filter (round(m, 9) >= 0.8) core from mm group by 1) join (select cluster, avg(together / sampled) mean_rate from pr group by 1) using (cluster)")
def hard_core(t):  # M12
    r = t.embeddings.select(F.col("vec_id").alias("item"), F.col("label").cast("long").alias("label"))
    return G.hard_core(r, bootstrap_runs(t)).select("cluster", "n", F.round("mean_rate", 6).alias("mean_rate"), "core")


@query(f"with {RUNS}, c as (select x.run run_a, y.run run_b, x.label label_a, y.label label_b, count(*) n from m x join m y on x.item = y.item and x.run < y.run group by all), s as (select run, label, count(*) s from m group by all) select c.run_a, c.run_b, label_a, label_b, round(n / (a.s + b.s - n), 6) jaccard from c join s a on a.run = run_a and a.label = label_a join s b on b.run = run_b and b.label = label_b")
def cluster_jaccard(t):  # J15 J18 M2f
    return G.cluster_jaccard(labelings(t)).withColumn("jaccard", F.round("jaccard", 6))


@query(f"with {RUNS}, c as (select x.run run_a, y.run run_b, count(*) common from m x join m y on x.item = y.item and x.run < y.run where not (x.run = 'a' and y.run = 'c' and x.item % 3 = 0) group by all) select * from c order by common desc, run_a, run_b limit 1")
def best_run_pair(t):  # J15
    r = labelings(t)
    return G.best_pair(r.where("not (run = 'c' and item % 3 = 0)").unionByName(r.where("run = 'c' and item % 3 = 0").withColumn("item", -F.col("item") - 1)))


@query(f"with {RUNS}, c as (select x.run run_a, y.run run_b, x.label label_a, y.label label_b, count(*) n from m x join m y on x.item = y.item and x.run < y.run group by all), s as (select run, label, count(*) s from m group by all) select a.run run_a, b.run run_b, a.label label_a, b.label label_b, round(coalesce(n, 0) / (a.s + b.s - coalesce(n, 0)), 6) jaccard from s a join s b on a.run < b.run left join c on c.run_a = a.run and c.run_b = b.run and c.label_a = a.label and c.label_b = b.label")
def cluster_jaccard_all(t):  # J18
    return G.cluster_jaccard(labelings(t), zeros=True).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""with {RATES.split(',\n w as')[0]}, e as (select vec_id item, case when label = 9 then 1000 + vec_id else label end cluster from embeddings), z as (select cluster, count(*) n from e group by 1), k as (select cluster, run, label, count(*) k from b join e using (item) group by all),
 t as (select cluster, sum(k * (k - 1) / 2) t from k group by 1) select cast(cluster as bigint) cluster, n, case when n < 2 then 1.0 else round(coalesce(t, 0) / (n * (n - 1) / 2 * 6), 6) end stability from z left join t using (cluster)""")
def perturbed_cluster_stability(t):  # M13
    base = t.embeddings.select(F.col("vec_id").alias("item"), F.when(F.col("label") == 9, F.col("vec_id") + 1000).otherwise(F.col("label")).cast("long").alias("label"))
    return G.perturbation_stability(base, bootstrap_runs(t), 6).withColumn("stability", F.round("stability", 6))


@query()
def noisy_cluster_stability(t):  # M13
    e = t.embeddings.select(F.col("vec_id").alias("item"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return C.noisy_stability(e, 8, n_runs=3).withColumn("stability", F.round("stability", 6))


@query()
def hungarian_match(t):  # D10
    return C.match_clusters(labelings(t)).withColumn("jaccard", F.round("jaccard", 6))


@query()
def taxonomy_stability(t):  # M14
    r = labelings(t)
    e = t.embeddings.select(F.col("vec_id").alias("item"), "embedding")
    vectors = A.centroids(r.join(e, "item").withColumn("key", F.struct("run", "label")), "key", "embedding").select("key.*", F.col("centroid").alias("vector"))
    return C.taxonomy_stability(r, vectors)[1].select("pairs", *(F.round(c, 6).alias(c) for c in ("mean", "std")))


@query()
def taxonomy_transfer(t):  # M15 U5
    return C.transfer(_centroid_pairs(t))


@query()
def taxonomy_transfer_rate(t):  # M15
    return C.transfer_rate(C.transfer(_centroid_pairs(t))).withColumn("rate", F.round("rate", 6))


def _centroid_pairs(t: Tables) -> DataFrame:
    from corpuslens.functions.vectors import cosine

    half = lambda k, name: A.centroids(t.embeddings.where(f"vec_id % 2 = {k}"), "label", "embedding").select(F.col("label").cast("long").alias(name), F.col("centroid").alias(f"c{name}"))
    pairs = half(0, "a").crossJoin(half(1, "b"))  # ten centroids a side
    return pairs.select("a", "b", cosine("ca", "cb").alias("similarity"))


@query()
def agglomerative_clusters(t):  # D8
    e = t.embeddings.withColumn("chunk", F.floor(F.col("vec_id") / 80).cast("long"))
    return C.cluster_groups(e, "chunk", "vec_id", "embedding", 8)


@query()
def average_linkage_clusters(t):  # D8 M13
    from corpuslens.operators.linkage import cut, linkage

    e = t.embeddings.withColumn("g", F.lit(0))
    return cut(e, linkage(e, "g", "vec_id", "embedding", finish=256), "g", "vec_id", k=8).select("vec_id", "cluster")


@query()
def reduced_clusters(t):  # D11 W8
    return C.reduce_clusters(t.embeddings.select(F.col("vec_id").alias("item"), "embedding"), "item", "embedding", chunk=80, most=12)


@query()
def scalable_clusters(t):  # D9
    return C.scalable_clusters(t.embeddings, "embedding", 8).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def density_clusters(t):  # D9
    from corpuslens.operators.density import density_clusters as by_density

    return by_density(t.embeddings, "vec_id", "embedding").groupBy("cluster").agg(F.count("*").alias("n"))


def cluster_document(t: Tables) -> DataFrame:
    """A cluster document over articles 0 .. n - 1: a cluster a label under 8, the others as singletons."""
    e = t.embeddings
    c = e.where("label < 8").groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("m"))
    clusters = c.agg(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("label").cast("string")).alias("cluster_name"), F.lit("").alias("description"), F.col("m").alias("member_indices")))).alias("emergent_clusters"))
    single = e.where("label >= 8").agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id").alias("index"), F.lit("alone").alias("why_unique")))).alias("singletons"))
    return clusters.crossJoin(single)


_MEMBERS = "a as (select vec_id, 'C' || vec_id % 7 country, label from embeddings), k as (select case when label < 8 then 'c' || label else 'Singleton ' || vec_id end cluster_name, label >= 8 singleton, vec_id item, country from a)"


@query(f"with {_MEMBERS} select cluster_name, singleton, cast(sum(n) as bigint) articles, string_agg(country || ':' || n, ',' order by country) signature from (select cluster_name, singleton, country, count(*) n from k group by all) group by all")
def cluster_table(t):  # K12 A9
    a = t.embeddings.select(F.col("vec_id").alias("index"), F.col("vec_id").alias("item"), F.concat(F.lit("C"), (F.col("vec_id") % 7).cast("string")).alias("country"))
    c, _ = C.cluster_tables(cluster_document(t), a)
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("signature")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return c.select("cluster_name", "singleton", "articles", listed.alias("signature"))


@query(f"with {_MEMBERS} select cluster_name, item from k")
def cluster_members(t):  # K12
    a = t.embeddings.select(F.col("vec_id").alias("index"), F.col("vec_id").alias("item"), F.lit("x").alias("country"))
    return C.cluster_tables(cluster_document(t), a)[1].select("cluster_name", "item")


@query()
def bootstrap_ci(t):  # M18
    return C.bootstrap_ci(t.labels.select("doc_id", "quality"), "quality")


@query("""with a as (select doc_id item, quality label from labels union all select doc_id, toxic from labels), c as (select item, label, count(*) c from a group by all), m as (select item, sum(c) m, sum(c * (c - 1)) s from c group by 1 having sum(c) >= 2),
 w as (select count(*) items, sum(m) n, sum((m * (m - 1) - s) / (m - 1)) u from m), p as (select sum(t * (t - 1)) l from (select label, sum(c) t from c group by 1))
 select items, round(u / n, 6) observed, round((n * (n - 1) - l) / (n * (n - 1)), 6) expected, round(1 - (u / n) / ((n * (n - 1) - l) / (n * (n - 1))), 6) alpha from w, p""")
def krippendorff_nominal(t):  # M16 J16
    a = t.labels.select(F.col("doc_id").alias("item"), F.explode(F.array("quality", "toxic")).alias("label"))
    return G.krippendorff_nominal(a).select("items", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "alpha")))


@query("select quality, toxic, count(*) n from labels group by all")
def annotator_confusion(t):  # M16
    return t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def _distance(x: str, y: str) -> str:
    both, all_ = f"len(list_intersect({x}, {y}))", f"len(list_distinct(list_concat({x}, {y})))"
    return f"case when len({x}) = {both} and len({y}) = {both} then 0.0 when {both} = 0 then 1.0 when len({x}) = {both} or len({y}) = {both} then 1 - {both} / {all_} * 2 / 3 else 1 - {both} / {all_} / 3 end"


@query(f"""with p as (select event_id // 7 item, coalesce(list(distinct event_type order by event_type) filter (event_id % 2 = 0), []) a, coalesce(list(distinct event_type order by event_type) filter (event_id % 2 = 1), []) b from events group by 1),
 o as (select avg({_distance('a', 'b')}) observed from p where len(a) > 0 or len(b) > 0), u as (select s, count(*) c from (select a s from p union all select b from p) where len(s) > 0 group by 1),
 e as (select sum(case when x.s = y.s then x.c * (x.c - 1) / 2 else x.c * y.c end * ({_distance('x.s', 'y.s')})) / sum(case when x.s = y.s then x.c * (x.c - 1) / 2 else x.c * y.c end) expected from u x join u y on x.s <= y.s)
 select round(observed, 6) observed, round(expected, 6) expected, round(1 - observed / expected, 6) alpha from o, e""")
def masi_alpha(t):  # M17 U6 M3f
    kinds = lambda parity: F.sort_array(F.collect_set(F.when(F.col("event_id") % 2 == parity, F.col("event_type"))))
    a = G.alpha_sets(t.events.groupBy(F.floor(F.col("event_id") / 7)).agg(kinds(0).alias("a"), kinds(1).alias("b")), "a", "b")
    return a.select(*(F.round(c, 6).alias(c) for c in ("observed", "expected", "alpha")))


@query("""with x as (select cast(length(text) as double) v, quality f from labels join documents using (doc_id)), g as (select count(*) filter (f = 0) n0, count(*) filter (f = 1) n1, avg(v) filter (f = 0) m0, avg(v) filter (f = 1) m1, var_samp(v) filter (f = 0) v0, var_samp(v) filter (f = 1) v1, corr(v, cast(f as double)) r from x)
 select n0, n1, round(m0, 4) m0, round(m1, 4) m1, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 6) t, round(r, 6) r from g""")
def pooled_t_by_flag(t):  # M20 M21
    x = t.labels.join(t.documents, "doc_id").select(F.length("text").cast("double").alias("v"), "quality")
    return G.pooled_t(x, "v", "quality").select("n0", "n1", F.round("m0", 4).alias("m0"), F.round("m1", 4).alias("m1"), F.round("t", 6).alias("t"), F.round("r", 6).alias("r"))


@query()
def association_p_values(t):  # M20 M21 M7f
    from corpuslens.functions.text import significance_stars

    x = t.labels.join(t.documents, "doc_id").select(F.length("text").alias("v"), "quality", "toxic")
    rows = [(f, G.association_p(x, "v", f)) for f in ("quality", "toxic")]
    return t.spark.createDataFrame(rows, "flag string, p double").withColumn("stars", significance_stars("p"))
