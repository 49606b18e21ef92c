"""Lexical and syntactic asymmetry measures.  Every lexicon is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as X

WINDOW = 15


def actor_vocabulary(docs: DataFrame, actors: dict[str, Sequence[str]], sanitizing: Sequence[str], condemnatory: Sequence[str], window: int = WINDOW, least: int = 50) -> DataFrame:
    """doc_id, source, actor, mentions, sanitizing, condemnatory, score, sanitizing_terms, condemnatory_terms, for texts of at least
    least characters.  Actors are phrases of tokens; a place at which several phrases of an actor begin is one mention.  A mention looks at
    the tokens within window places before and window - 1 after it; tokens near several mentions count for each; a term of both
    lexicons is sanitizing.  All inside a row: no shuffle.  A token is looked up in the lexicons once."""
    sanitizing, condemnatory = [t.lower() for t in sanitizing], [t.lower() for t in condemnatory]
    kept = docs.where(F.length(X.trim("text")) >= least)
    rows = X.computed_once(kept.select("doc_id", "source", "text"), tokens=X.tokens("text")).drop("text")
    rows = X.computed_once(rows, terms=F.transform("tokens", lambda w: F.when(w.isin(*sanitizing, *condemnatory), w)))
    near = lambda i: F.filter(F.slice("terms", F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)) + window), lambda w: w.isNotNull())
    parts = [F.struct(F.lit(name).alias("actor"), F.transform(X.phrase_starts("tokens", phrases), near).alias("near")) for name, phrases in actors.items()]
    each = rows.select("doc_id", "source", F.inline(F.array(*parts))).where(F.size("near") > 0)
    each = X.computed_once(each.withColumn("mentions", F.size("near").cast("long")), found=F.flatten("near")).drop("near")
    each = X.computed_once(each, sanitizing_terms=F.filter("found", lambda w: w.isin(*sanitizing)), condemnatory_terms=F.filter("found", lambda w: ~w.isin(*sanitizing))).drop("found")
    n = {k: F.size(f"{k}_terms").cast("long") for k in ("sanitizing", "condemnatory")}
    return each.select("doc_id", "source", "actor", "mentions", *(c.alias(k) for k, c in n.items()), (n["sanitizing"] - n["condemnatory"]).alias("score"), "sanitizing_terms", "condemnatory_terms")


def double_standard(scores: DataFrame, group: str, actors_a: Sequence[str], actors_b: Sequence[str]) -> DataFrame:
    """Mean score of either group of actors by group (0 if absent) and the gap between them."""
    m = lambda a: F.coalesce(F.avg(F.when(F.col("actor").isin(*a), F.col("score"))), F.lit(0.0))
    return scores.groupBy(group).agg(m(actors_a).alias("mean_a"), m(actors_b).alias("mean_b")).withColumn("gap", F.col("mean_a") - F.col("mean_b"))


def term_frequency(scores: DataFrame, actors: dict[str, Sequence[str]], k: int) -> DataFrame:
    """side, kind, term, n, rank: the k terms most often found near each side's actors (ties by term)."""
    from corpuslens.operators.relational import top_per_group

    side = F.lit(None).cast("string")
    for name, own in actors.items():
        side = F.when(F.col("actor").isin(*own), name).otherwise(side)
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_terms").alias("terms")) for kind in ("sanitizing", "condemnatory")))
    each = scores.select(side.alias("side"), F.inline(kinds)).where("side is not null").select("side", "kind", F.explode("terms").alias("term"))
    return top_per_group(each.groupBy("side", "kind", "term").agg(F.count("*").alias("n")), ["side", "kind"], [F.col("n").desc(), "term"], k)


def elaboration(docs: DataFrame, side_a: Sequence[str], side_b: Sequence[str], named: Sequence[str]) -> DataFrame:
    """Per document a composite for either side over paragraphs that mention it: words + 50 a paragraph with a named source +
    30 a paragraph that opens with a quote.  ratio is larger / smaller (the larger itself if the other is 0), null if both
    are 0; tokenism above 4, severe above 8."""
    p = docs.select("doc_id", F.explode(X.paragraphs("text")).alias("p"))

    def composite(side: Sequence[str]) -> Column:
        worth = F.size(X.words("p")) + F.when(X.any_term("p", named), 50).otherwise(0) + F.when(F.col("p").rlike('^["“]'), 30).otherwise(0)
        return F.sum(F.when(X.any_term("p", side), worth).otherwise(0)).cast("long")

    g = p.groupBy("doc_id").agg(composite(side_a).alias("a"), composite(side_b).alias("b"))
    high, low = F.greatest("a", "b"), F.least("a", "b")
    ratio = F.when(high > 0, F.when(low > 0, high / low).otherwise(high.cast("double")))
    return g.withColumn("ratio", ratio).withColumn("tokenism", F.coalesce(F.col("ratio") > 4, F.lit(False))).withColumn("severe", F.coalesce(F.col("ratio") > 8, F.lit(False)))


def sentence_features(docs: DataFrame, sides: tuple[Sequence[str], Sequence[str]], hedges: Sequence[str], attribution: Sequence[str], passive: Sequence[str], concessive: Sequence[str]) -> DataFrame:
    """Per document, over its sentences: n, attribution and passive share, precision of either side ((numbers - hedges) /
    max(1, sentences)), sentences that name just one side with a number, and sentences with a concessive marker.  A sentence is
    looked at once, and the sums are taken inside the row: no shuffle."""

    def look(s: Column) -> Column:
        has = lambda terms: s.rlike(r"(^|[ \n,;:])(" + "|".join(terms) + r")([ \n,;:.!?]|\z)")
        number = X.number_count(s)
        hedged = F.size(F.filter(X.words(s), lambda w: w.isin(*hedges)))
        return F.struct(has(attribution).alias("att"), has(passive).alias("pas"), has(concessive).alias("con"), has(sides[0]).alias("a"), has(sides[1]).alias("b"), number.alias("num"), (number - hedged).alias("sure"))

    f = X.computed_once(docs.select("doc_id", "text"), f=F.transform(X.sentences(F.lower("text")), look)).where(F.size("f") > 0)
    n = F.size("f")
    count = lambda test: F.size(F.filter("f", test)).cast("long")

    def precision(side: str) -> Column:
        sure = F.aggregate("f", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x[side], x["sure"]).otherwise(0))
        return sure / F.greatest(count(lambda x: x[side]), F.lit(1))

    return f.select(
        "doc_id",
        n.cast("long").alias("sentences"),
        (count(lambda x: x["att"]) / n).alias("attribution_share"),
        (count(lambda x: x["pas"]) / n).alias("passive_share"),
        precision("a").alias("precision_a"),
        precision("b").alias("precision_b"),
        count(lambda x: x["a"] & ~x["b"] & (x["num"] > 0)).alias("specific_a"),
        count(lambda x: x["b"] & ~x["a"] & (x["num"] > 0)).alias("specific_b"),
        count(lambda x: x["con"]).alias("concessive"),
    )


# Concessive markers in the order they are tried, by what they part, and the wordings of casualties.
CONCESSIVE_MARKERS = ("although", "though", "even though", "while", "despite", "in spite of", "notwithstanding", "however", "nevertheless", "nonetheless", "but", "yet")
LEADING_MARKERS = ("although", "though", "even though", "while", "despite")
TURNING_MARKERS = ("however",)
JOINING_MARKERS = ("but", "yet")
CASUALTY_WORDS = ("killed", "died", "dead", "wounded", "injured", "casualties", "martyred")
CASUALTY_NAMED = r"(?i)(?:killed|died|dead|wounded|injured|martyred)\s.*?(?:named|identified as|was\s)"
CASUALTY_NUMBER = r"(?i)(\d+)\s+(?:people|civilians|soldiers|fighters|militants|casualties|dead|killed|wounded|injured)"
CASUALTY_HEDGED = r"(?i)(?:reports?\s+(?:of|suggest)|casualties\s+(?:were|are)\s+(?:reported|estimated)|(?:allegedly|reportedly)\s+(?:killed|wounded)|unconfirmed\s+(?:reports?|casualties))"


def concessive_constructions(text: Column | str, markers: Sequence[str] = CONCESSIVE_MARKERS, leading: Sequence[str] = LEADING_MARKERS, turning: Sequence[str] = TURNING_MARKERS, joining: Sequence[str] = JOINING_MARKERS, least: int = 10) -> Column:
    """Concessive constructions, array of (pattern, subordinated, main), one a sentence at most: the first marker in order that the
    lowered sentence holds decides, even if it parts nothing.  A leading marker subordinates what stands between it and the next comma
    (over 5 characters on), a turning one all before it, a joining one all before it as a word of its own; the subordinated part must
    be over least characters long."""

    def part(s: Column) -> Column:
        low = F.lower(s)
        out = F.lit(None)
        for m in reversed(markers):
            size = len(m)
            at = F.instr(low, m)
            rest = F.substr(s, at + size)
            comma = F.instr(rest, ",")
            if m in leading:
                found = F.when(comma > 6, F.struct(F.lit(m).alias("pattern"), X.trim(F.left(rest, comma - 1)).alias("subordinated"), X.trim(F.substr(rest, comma + 1)).alias("main")))
            elif m in turning:
                found = F.struct(F.lit(m).alias("pattern"), F.rtrim(X.trim(F.left(s, at - 1)), F.lit(",")).alias("subordinated"), X.trim(F.ltrim(X.trim(rest), F.lit(","))).alias("main"))
            elif m in joining:
                spot = F.instr(low, f" {m} ")
                found = F.when(spot > 1, F.struct(F.lit(m).alias("pattern"), X.trim(F.left(s, spot - 1)).alias("subordinated"), X.trim(F.substr(s, spot + size + 1)).alias("main")))
            else:
                found = F.lit(None)
            out = F.when(at > 0, found).otherwise(out)
        return out

    return F.filter(F.transform(X.sentences(text), part), lambda p: p.isNotNull() & (F.length(p["subordinated"]) > least))


def marker_frequency(docs: DataFrame, constructions: str = "constructions") -> DataFrame:
    """pattern, n: how often each marker parts a sentence, over all documents."""
    return docs.select(F.explode(constructions).alias("c")).groupBy(F.col("c.pattern").alias("pattern")).agg(F.count("*").alias("n"))


def casualty_counts(text: Column | str, sides: dict[str, Sequence[str]], words: Sequence[str] = CASUALTY_WORDS, named: str = CASUALTY_NAMED, number: str = CASUALTY_NUMBER, hedged: str = CASUALTY_HEDGED) -> Column:
    """struct of named, numbered and hedged casualties in the text, and sides: for each side, as <side>_named ..., the sentences with
    a casualty word that mention only that side."""
    t = F.col(text) if isinstance(text, str) else text
    kinds = {"named": named, "numbered": number, "hedged": hedged}
    out = [F.regexp_count(t, F.lit(p)).cast("long").alias(k) for k, p in kinds.items()]
    names = [f"{side}_{k}" for side in sides for k in kinds]
    zero = F.lit(0).cast("long")

    def add(total: Column, s: Column) -> Column:
        """Every sentence is looked at once."""
        met = {side: X.any_term(s, terms) for side, terms in sides.items()}
        more = []
        for side in sides:
            alone = met[side]
            for other in sides:
                alone = alone if other == side else alone & ~met[other]
            more += [(total[f"{side}_{k}"] + F.when(X.any_term(s, words) & alone & s.rlike(p), 1).otherwise(0)).alias(f"{side}_{k}") for k, p in kinds.items()]
        return F.struct(*more)

    sums = F.aggregate(F.split(t, r"\. "), F.struct(*(zero.alias(n) for n in names)), add)
    return F.struct(*out, sums.alias("sides"))


def opening_subject(text: Column | str, verbs: Sequence[str]) -> Column:
    """The words before the first verb of the first sentence (a stand-in for a parser's subject); null if the sentence has none of the
    verbs or opens with one."""
    first = X.words(F.get(X.sentences(text), F.lit(0)))
    at = F.array_position(F.transform(first, lambda w: F.lower(F.trim(w, F.lit(".,;:!?"))).isin(*verbs)), True)
    return F.when(at > 1, F.array_join(F.slice(first, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), " "))


def ambiguity(passive: Column, attribution: Column, elaboration_ratio: Column) -> Column:
    """.3 passive + .3 attribution + .4 min(elaboration / 10, 1); a null elaboration counts 1."""
    return 0.3 * passive + 0.3 * attribution + 0.4 * F.least(F.coalesce(elaboration_ratio, F.lit(1.0)) / 10, F.lit(1.0))


def quotes_by_speaker(docs: DataFrame, classes: Sequence[tuple[str, Sequence[str]]], reach: int = 150) -> DataFrame:
    """doc_id, speaker, n: quotes by the class named within reach characters around them.  A quote's row carries its two neighbours'
    ends, not the text."""
    parts = docs.select("doc_id", F.split("text", '["“”]').alias("all"))
    beside = lambda x, i: F.struct(i.alias("pos"), x.alias("span"), F.concat_ws(" ", F.right(F.get("all", i - 1), F.lit(reach)), F.left(F.coalesce(F.get("all", i + 1), F.lit("")), F.lit(reach))).alias("around"))
    q = parts.select("doc_id", F.explode(F.filter(F.transform("all", beside), lambda s: (s["pos"] % 2 == 1) & (F.length(s["span"]) >= 20))).alias("q"))
    return q.select("doc_id", X.first_class(F.col("q.around"), classes, "unattributed").alias("speaker")).groupBy("doc_id", "speaker").agg(F.count("*").alias("n"))


def mirror_gap(frames: DataFrame, home: Column, quoted_home: Column, quoted_total: Column) -> DataFrame:
    """Home and foreign articles and distinct frames, and the mean share of home quotes; a null country is on neither side."""
    ratio = F.avg(F.when(home & (quoted_total > 0), quoted_home / quoted_total))
    return frames.agg(F.count_if(home).alias("home_articles"), F.count_if(~home).alias("world_articles"), F.count_distinct(F.when(home, F.col("frame"))).alias("home_frames"), F.count_distinct(F.when(~home, F.col("frame"))).alias("world_frames"), F.coalesce(ratio, F.lit(0.0)).alias("domestic_ratio"))
