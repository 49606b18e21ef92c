"""Queries over lexical and syntactic asymmetry; lexicons are stand-ins that occur in the driver's prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import bias as B

from .registry import query
from .relational import OUTLETS, outlets

ACTORS = {"a1": ["of the", "the the the", "the"], "a2": ["is"], "b": ["and", "to the"]}
SANITIZING, CONDEMNATORY = ["is", "that", "it"], ["for", "was", "on", "it"]

SCORES = r"""tk as (select doc_id, source, regexp_extract_all(lower(text), '(?:\p{L}\.){2,}|[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]') w from documents where length(trim(text)) >= 50),
 ps as (select doc_id, source, w, unnest(range(1, len(w) + 1)) i from tk), an as (select *, array_to_string(w[i:i + 1], ' ') w2, array_to_string(w[i:i + 2], ' ') w3 from ps),
 mt as (select doc_id, source, actor, w[greatest(i - 15, 1):i + 14] n from an join (values ('a1'), ('a2'), ('b')) v(actor) on (actor = 'a1' and (w[i] = 'the' or w2 = 'of the' or w3 = 'the the the')) or (actor = 'a2' and w[i] = 'is') or (actor = 'b' and (w[i] = 'and' or w2 = 'to the'))),
 sc as (select doc_id, source, actor, count(*) mentions, cast(sum(len(list_filter(n, lambda x: x in ('is', 'that', 'it')))) as bigint) sanitizing, cast(sum(len(list_filter(n, lambda x: x in ('for', 'was', 'on')))) as bigint) condemnatory from mt group by all)"""


def scores(t):
    return B.actor_vocabulary(t.documents, ACTORS, SANITIZING, CONDEMNATORY)


@query(f"with {SCORES} select doc_id, actor, mentions, sanitizing, condemnatory, sanitizing - condemnatory score from sc")
def actor_vocabulary_scores(t):  # M23 J20
    return scores(t).select("doc_id", "actor", "mentions", "sanitizing", "condemnatory", "score")


@query(f"""with {SCORES}, x as (select case when actor = 'b' then 'b' else 'a' end side, unnest(n) term from mt), y as (select side, case when term in ('is', 'that', 'it') then 'sanitizing' else 'condemnatory' end kind, term, count(*) n from x where term in ('is', 'that', 'it', 'for', 'was', 'on') group by all)
 select * from (select *, row_number() over (partition by side, kind order by n desc, term) rank from y) where rank <= 2""")
def actor_terms(t):  # M23
    return B.term_frequency(scores(t), {"a": ["a1", "a2"], "b": ["b"]}, 2)


@query(f"with {SCORES} select source, round(coalesce(avg(sanitizing - condemnatory) filter (actor <> 'b'), 0), 6) mean_a, round(coalesce(avg(sanitizing - condemnatory) filter (actor = 'b'), 0), 6) mean_b, round(coalesce(avg(sanitizing - condemnatory) filter (actor <> 'b'), 0) - coalesce(avg(sanitizing - condemnatory) filter (actor = 'b'), 0), 6) gap from sc group by 1")
def double_standard(t):  # M24 A26
    return B.double_standard(scores(t), "source", ["a1", "a2"], ["b"]).select("source", *(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "gap")))


@query(f"with {SCORES}, g as (select doc_id, avg(sanitizing - condemnatory) filter (actor = 'a1') a, avg(sanitizing - condemnatory) filter (actor = 'b') b from sc group by 1) select count(*) n, round(avg(a - b), 6) mean_gap, round(corr(a - b, cast(toxic as double)), 6) r from g join labels using (doc_id) where a is not null and b is not null")
def framing_gap_correlation(t):  # M22
    m = lambda k: F.avg(F.when(F.col("actor") == k, F.col("score")))
    g = scores(t).groupBy("doc_id").agg((m("a1") - m("b")).alias("gap")).where("gap is not null").join(t.labels, "doc_id")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.corr("gap", F.col("toxic").cast("double")), 6).alias("r"))


ELABORATION = """pp as (select doc_id, trim(unnest(string_split(text, chr(10)))) p from documents where text is not null), pw as (select doc_id, p, lower(p) l, len(list_filter(regexp_split_to_array(p, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) + case when contains(lower(p), ' with ') or contains(lower(p), ' by ') then 50 else 0 end + case when regexp_matches(p, '^["“]') then 30 else 0 end n from pp where length(p) > 30),
 el as (select doc_id, cast(sum(case when contains(l, ' was ') or contains(l, ' que ') then n else 0 end) as bigint) a, cast(sum(case when contains(l, ' this ') or contains(l, ' und ') then n else 0 end) as bigint) b from pw group by 1),
 er as (select doc_id, a, b, case when greatest(a, b) > 0 then case when least(a, b) > 0 then greatest(a, b) / least(a, b) else cast(greatest(a, b) as double) end end ratio from el)"""


def elaborated(t):
    return B.elaboration(t.documents.where("text is not null"), [" was ", " que "], [" this ", " und "], [" with ", " by "])


@query(f"with {ELABORATION} select doc_id, a, b, round(ratio, 6) ratio, coalesce(ratio > 4, false) tokenism, coalesce(ratio > 8, false) severe from er")
def elaboration_ratio(t):  # M27 F13
    return elaborated(t).withColumn("ratio", F.round("ratio", 6))


SENTENCES = r"""ss as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[.!?]+[ \n]+'), lambda x: x <> '')) s from documents where text is not null),
 sf as (select doc_id, s, regexp_matches(s, '(^|[ \n,;:])(with|by)([ \n,;:.!?]|$)') att, regexp_matches(s, '(^|[ \n,;:])(was|are)([ \n,;:.!?]|$)') pas, regexp_matches(s, '(^|[ \n,;:])(as|this|que)([ \n,;:.!?]|$)') con, regexp_matches(s, '(^|[ \n,;:])(the|la)([ \n,;:.!?]|$)') a, regexp_matches(s, '(^|[ \n,;:])(and|der)([ \n,;:.!?]|$)') b, len(regexp_extract_all(s, '\b[0-9]+\b')) num, len(list_filter(regexp_split_to_array(s, '[ \t\n\x0B\f\r]+'), lambda w: w in ('on', 'in'))) hed from ss),
 ff as (select doc_id, count(*) sentences, avg(cast(att as int)) attribution_share, avg(cast(pas as int)) passive_share, sum(case when a then num - hed else 0 end) / greatest(count(*) filter (a), 1) precision_a, sum(case when b then num - hed else 0 end) / greatest(count(*) filter (b), 1) precision_b, count(*) filter (a and not b and num > 0) specific_a, count(*) filter (b and not a and num > 0) specific_b, count(*) filter (con) concessive from sf group by 1)"""


def features(t):
    return B.sentence_features(t.documents.where("text is not null"), (["the", "la"], ["and", "der"]), ["on", "in"], ["with", "by"], ["was", "are"], ["as", "this", "que"])


@query(f"with {SENTENCES} select doc_id, sentences, round(attribution_share, 6) attribution_share, round(passive_share, 6) passive_share, round(precision_a, 6) precision_a, round(precision_b, 6) precision_b, round(precision_a - precision_b, 3) precision_gap, specific_a, specific_b, concessive from ff")
def sentence_asymmetry(t):  # M25 M26 M29 D5 F8 F11
    f = features(t)
    return f.select("doc_id", "sentences", *(F.round(c, 6).alias(c) for c in ("attribution_share", "passive_share", "precision_a", "precision_b")), F.round(F.col("precision_a") - F.col("precision_b"), 3).alias("precision_gap"), "specific_a", "specific_b", "concessive")


@query(f"with {SENTENCES} select case when passive_share < 0.2 then '<.2' when passive_share < 0.4 then '<.4' when passive_share < 0.6 then '<.6' else 'rest' end bucket, count(*) n, round(avg(attribution_share), 5) attribution, count(*) filter (concessive > 3) heavy from ff group by 1")
def syntactic_report(t):  # M30 A20
    from corpuslens.operators.aggregates import bucket

    b = bucket(F.col("passive_share"), [0.2, 0.4, 0.6], ["<.2", "<.4", "<.6", "rest"])
    return features(t).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("attribution_share"), 5).alias("attribution"), F.count_if(F.col("concessive") > 3).alias("heavy"))


AMBIGUITY = f"""{SENTENCES}, {ELABORATION}, am as (select ff.doc_id, round(0.3 * passive_share + 0.3 * attribution_share + 0.4 * least(coalesce(ratio, 1) / 10, 1), 6) score, coalesce(ratio > 8, false) severe from ff left join er on er.doc_id = ff.doc_id)"""


def ambiguous(t, of=None):
    """Scores of all documents, or of those that of holds: the texts are read after the choice."""
    d = t.documents.where("text is not null")
    d = d if of is None else d.join(of, "doc_id", "left_semi")
    lexicons = ((["the", "la"], ["and", "der"]), ["on", "in"], ["with", "by"], ["was", "are"], ["as", "this", "que"])
    j = B.sentence_features(d, *lexicons).join(B.elaboration(d, [" was ", " que "], [" this ", " und "], [" with ", " by "]).select("doc_id", "ratio", "severe"), "doc_id", "left")
    return j.select("doc_id", F.round(B.ambiguity(F.col("passive_share"), F.col("attribution_share"), F.col("ratio")), 6).alias("score"), F.coalesce("severe", F.lit(False)).alias("severe"))


@query(f"with {AMBIGUITY} select am.doc_id, score from am join labels l on l.doc_id = am.doc_id where quality <> toxic order by score desc, am.doc_id limit 15")
def ambiguity_ranking(t):  # M4f M31 L2
    chosen = t.labels.where("quality <> toxic").select("doc_id")
    return ambiguous(t, chosen).join(chosen, "doc_id").orderBy(F.desc("score"), "doc_id").limit(15).select("doc_id", "score")


@query(f"with {AMBIGUITY}, top as (select am.doc_id from am join labels l on l.doc_id = am.doc_id where quality <> toxic and not severe order by score desc, am.doc_id limit 15) select doc_id from documents where lang = 'es' union select doc_id from top")
def presupposition_targets(t):  # M31 U1
    chosen = t.labels.where("quality <> toxic").select("doc_id")
    top = ambiguous(t, chosen).where("not severe").join(chosen, "doc_id").orderBy(F.desc("score"), "doc_id").limit(15).select("doc_id")
    return t.documents.where("lang = 'es'").select("doc_id").union(top).distinct()


@query("""with p as (select doc_id, regexp_split_to_array(text, '["“”]') p from documents where contains(text, '"')), q as (select doc_id, p, unnest(range(2, len(p) + 1, 2)) i from p),
 r as (select doc_id, lower(right(p[i - 1], 150) || ' ' || left(coalesce(p[i + 1], ''), 150)) near from q where length(p[i]) >= 20) select doc_id, case when contains(near, 'the') then 'official' when contains(near, 'que') or contains(near, 'und') then 'civil' else 'unattributed' end speaker, count(*) n from r group by 1, 2""")
def quotes_by_speaker(t):  # M28 J21
    return B.quotes_by_speaker(t.documents.where("text like '%\"%'"), [("official", ["the"]), ("civil", ["que", "und"])])


@query(f"""with {OUTLETS}, f as (select d.doc_id, o.region, d.lang frame, count(*) filter (role = 'user') q, count(*) total from documents d join outlets o on o.outlet = d.source join conversations c on c.conv_id = d.doc_id group by all)
 select count(*) filter (region = 'AMERICA') home_articles, count(*) filter (region <> 'AMERICA') world_articles, count(distinct case when region = 'AMERICA' then frame end) home_frames, count(distinct case when region <> 'AMERICA' then frame end) world_frames, round(coalesce(avg(case when region = 'AMERICA' then q / total end), 0), 6) domestic_ratio from f""")
def mirror_gap(t):  # M32 J3 A15
    c = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count_if(F.col("role") == "user").alias("q"), F.count("*").alias("total"))
    f = t.documents.join(outlets(t), F.col("source") == F.col("outlet")).join(c, "doc_id").withColumn("frame", F.col("lang"))
    return B.mirror_gap(f, F.col("region") == "AMERICA", F.col("q"), F.col("total")).withColumn("domestic_ratio", F.round("domestic_ratio", 6))


MARKERS = {"markers": ["thand", "the", "of", "and", "to", "que"], "leading": ["the", "que"], "turning": ["thand"], "joining": ["and", "to"]}

CONCESSIVE = r"""cs as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '[.!?]+[ \n]+'), lambda x: x <> '')) s from documents where text is not null),
 cm as (select doc_id, s, case when contains(lower(s), 'thand') then 'thand' when contains(lower(s), 'the') then 'the' when contains(lower(s), 'of') then 'of' when contains(lower(s), 'and') then 'and' when contains(lower(s), 'to') then 'to' when contains(lower(s), 'que') then 'que' end m from cs),
 cr as (select *, substr(s, instr(lower(s), m) + length(m)) rest, instr(lower(s), ' ' || m || ' ') spot from cm where m is not null),
 cp as (select doc_id, m pattern, case when m in ('the', 'que') and instr(rest, ',') > 6 then trim(left(rest, instr(rest, ',') - 1)) when m = 'thand' then rtrim(trim(left(s, instr(lower(s), m) - 1)), ',') when m in ('and', 'to') and spot > 1 then trim(left(s, spot - 1)) end subordinated from cr),
 cc as (select * from cp where length(subordinated) > 10)"""


def constructions(t):
    return t.documents.where("text is not null").select("doc_id", B.concessive_constructions("text", **MARKERS).alias("constructions"))


@query(f"with {CONCESSIVE} select doc_id, pattern, count(*) n, max(length(subordinated)) longest from cc group by 1, 2")
def concessive_constructions(t):  # M29
    c = constructions(t).select("doc_id", F.explode("constructions").alias("c"))
    return c.groupBy("doc_id", F.col("c.pattern").alias("pattern")).agg(F.count("*").alias("n"), F.max(F.length("c.subordinated")).cast("long").alias("longest"))


@query(f"with {CONCESSIVE} select pattern, count(*) n from cc group by 1")
def concessive_marker_frequency(t):  # M30
    return B.marker_frequency(constructions(t))


CASUALTIES = {"words": ["the", "que"], "named": r"(?i)(?:the|of)\s[a-z]+\s(?:and|to)\s", "number": r"(?i)([a-z]+ing)\s+(?:of|the|and)", "hedged": r"(?i)(?:en|er)\s+(?:of|le)"}


@query(r"""with x as (select doc_id, text, list_filter(string_split(text, '. '), lambda s: contains(lower(s), 'the') or contains(lower(s), 'que')) s from documents where text is not null),
 y as (select *, list_filter(s, lambda x: contains(lower(x), 'ing') and not contains(lower(x), 'ea')) l, list_filter(s, lambda x: contains(lower(x), 'ea') and not contains(lower(x), 'ing')) r from x)
 select doc_id, cast(len(regexp_extract_all(text, '(?i)(?:the|of)\s[a-z]+\s(?:and|to)\s')) as bigint) named, cast(len(regexp_extract_all(text, '(?i)([a-z]+ing)\s+(?:of|the|and)')) as bigint) numbered, cast(len(regexp_extract_all(text, '(?i)(?:en|er)\s+(?:of|le)')) as bigint) hedged,
 cast(len(list_filter(l, lambda x: regexp_matches(x, '(?i)(?:the|of)\s[a-z]+\s(?:and|to)\s'))) as bigint) left_named, cast(len(list_filter(l, lambda x: regexp_matches(x, '(?i)([a-z]+ing)\s+(?:of|the|and)'))) as bigint) left_numbered, cast(len(list_filter(l, lambda x: regexp_matches(x, '(?i)(?:en|er)\s+(?:of|le)'))) as bigint) left_hedged,
 cast(len(list_filter(r, lambda x: regexp_matches(x, '(?i)(?:the|of)\s[a-z]+\s(?:and|to)\s'))) as bigint) right_named, cast(len(list_filter(r, lambda x: regexp_matches(x, '(?i)([a-z]+ing)\s+(?:of|the|and)'))) as bigint) right_numbered, cast(len(list_filter(r, lambda x: regexp_matches(x, '(?i)(?:en|er)\s+(?:of|le)'))) as bigint) right_hedged from y""")
def casualty_specificity(t):  # F8
    c = B.casualty_counts("text", {"left": ["ing"], "right": ["ea"]}, **CASUALTIES)
    d = X.computed_once(t.documents.where("text is not null").select("doc_id", "text"), c=c).select("doc_id", "c.*")
    return d.select("doc_id", "named", "numbered", "hedged", "sides.*")


@query(r"""with f as (select doc_id, list_filter(regexp_split_to_array(list_filter(regexp_split_to_array(text, '[.!?]+[ \n]+'), lambda x: x <> '')[1], '[ \t\n\x0B\f\r]+'), lambda w: w <> '') w from documents where text is not null),
 p as (select doc_id, w, list_position(list_transform(w, lambda x: lower(trim(x, '.,;:!?')) in ('the', 'of', 'que', 'der')), true) i from f) select doc_id, case when i > 1 then array_to_string(w[1:i - 1], ' ') end subject from p""")
def opening_subjects(t):  # D5
    return t.documents.where("text is not null").select("doc_id", B.opening_subject("text", ["the", "of", "que", "der"]).alias("subject"))
