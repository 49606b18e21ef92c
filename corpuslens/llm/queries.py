"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, taken_words

    return taken_words(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import CUT, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), bucket_of("doc_id", 3) != 1)
    scored = score(docs, model)
    return scored.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_fingerprint, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_turns

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return digests(format_turns(rows.unionByName(added)))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    train = bucket_of("doc_id", 10) != 0
    out = score_texts(table(spark, sf_dir, "documents"), train)
    return out.select("doc_id", (bucket_of("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import count_words, variants

    return variants(count_words(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"""w as (select doc_id, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
 p as (select doc_id, w, unnest(range(1, len(w) + 1)) i from w)"""


def _op4_sql() -> str:
    from .quality import Rules

    rules = Rules()
    lengths = sorted({*rules.ngram_shares, rules.window})
    flags = ", ".join(f"len(w) - i >= {n - 1} and count(*) over (partition by doc_id, case when len(w) - i >= {n - 1} then array_to_string(w[i:i + {n - 1}], ' ') end) > 1 f{n}" for n in lengths)
    covers = ", ".join(f"max(f{n}::int) over (partition by doc_id order by i rows between {n - 1} preceding and current row) c{n}" for n in lengths)
    sums = ", ".join(f"cast(sum(case when c{n} = 1 then length(w[i]) else 0 end) as bigint) dup_{n}gram_chars" for n in rules.ngram_shares)
    fills = ", ".join(f"coalesce(dup_{n}gram_chars, 0) dup_{n}gram_chars" for n in rules.ngram_shares)
    over = " or ".join(f"dup_{n}gram_chars > {share}::double * word_chars" for n, share in rules.ngram_shares.items())
    return f"""with {_WORDS}, f as (select *, {flags} from p), c as (select *, {covers} from f),
 s as (select doc_id, cast(sum(length(w[i])) as bigint) word_chars, cast(sum(c{rules.window}) as bigint) n_repeat_words, {sums} from c group by 1),
 l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) k from w),
 m as (select doc_id, line, row_number() over (partition by doc_id, line order by k) > 1 again from l where len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > 0),
 n as (select doc_id, count(*) filter (again) n_dup_lines, cast(coalesce(sum(length(line)) filter (again), 0) as bigint) dup_line_chars, cast(sum(length(line)) as bigint) line_chars from m group by 1),
 j as (select w.doc_id, cast(len(w) as bigint) n_words, coalesce(word_chars, 0) word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) n_symbols, coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, {fills}, coalesce(dup_line_chars, 0) dup_line_chars, coalesce(line_chars, 0) line_chars from w left join s using (doc_id) left join n using (doc_id)),
 b as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words base_failed from j)
 select *, not (base_failed or {over} or dup_line_chars > {rules.max_dup_line_share}::double * line_chars or n_symbols > {rules.max_symbol_share}::double * word_chars) kept from b"""


_OP6_SQL = r"""with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 x as (select *, (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, '</turn>', ''))) // 7 controls from c)
 select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256, cast(sum(15 + length(role) + length(text) + controls) as bigint) formatted_chars from x group by 1"""

_OP10_SQL = f"""with {_WORDS}, k as (select *, case when len(w) - i >= 19 then array_to_string(w[i:i + 19], ' ') end g from p), f as (select doc_id, i, w[i] word, g is not null and (doc_id, i) > min((doc_id, i)) over (partition by g) again from k),
 c as (select *, max(again::int) over (partition by doc_id order by i rows between 19 preceding and current row) = 1 gone from f),
 s as (select doc_id, count(*) n_words, count(*) filter (gone) n_removed, string_agg(word, ' ' order by i) filter (not gone) kept from c group by 1)
 select w.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join s using (doc_id)"""


#: crc32 of a text's UTF-8 bytes; its table is made by rule
_CRC_SQL = """recursive crc_step(b, x, k) as (select i, i, 0 from range(256) r(i) union all select b, case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end, k + 1 from crc_step where k < 8),
 crc_table as (select list(x order by b) tab from crc_step where k = 8)"""


def _crc(text: str) -> str:
    digits = f"hex(encode({text}))"
    codes = f"list_transform(range(1, length({digits}) + 1, 2), lambda p: (16 * (strpos('0123456789ABCDEF', {digits}[p]) - 1) + strpos('0123456789ABCDEF', {digits}[p + 1]) - 1)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint)"


_OP12_SQL = rf"""with {_CRC_SQL},
 runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) run from documents),
 hashed as (select run, n, {_crc("coalesce(doc_id::varchar, '') || ':' || run")} h from (select doc_id, run, count(*) n from runs where length(run) >= 7 group by 1, 2), crc_table),
 words as (select case when h % 31 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end word, cast(sum(n) as bigint) n from hashed group by 1 having length(word) >= 7 and sum(n) >= 2),
 cut as (select word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) rest from (select word, n, unnest(range(1, length(word) + 1)) i from words)),
 pairs as (select a.word, a.n, b.word near, b.n near_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, a.n, b.word, b.n from words a join cut b on a.word = b.rest union select b.word, b.n, a.word, a.n from words a join cut b on a.word = b.rest),
 best as (select word, count(*) n_near, arg_min(near, (-near_n, near)) near, max(near_n) near_n from pairs group by 1),
 placed as (select w.word, w.n, coalesce(n_near, 0) n_near, case when near_n >= 10 * w.n then near end form, case when near_n >= 10 * w.n then near_n end form_n from words w left join best using (word)),
 chain(word, node, k) as (select word, word, 0 from placed union all select c.word, p.form, k + 1 from chain c join placed p on c.node = p.word where p.form is not null)
 select word, form, root, n, n_near, form_n from placed join (select word, arg_max(node, k) root from chain group by 1) using (word)"""

_OP13_SQL = rf"""with {_CRC_SQL},
 words as (select 0 side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) word from documents
  union all select 1, null, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
 buckets as (select word, {_crc("word")} % 10000 bucket from (select distinct word from words), crc_table),
 counts as (select bucket, count(*) filter (side = 0) s, count(*) filter (side = 1) t from words join buckets using (word) group by 1),
 gains as (select bucket, floor(1000 * ln((t + 1)::double * ((sum(s) over ()) + 10000)::double / ((s + 1)::double * ((sum(t) over ()) + 10000)::double))) gain from counts),
 per_doc as (select doc_id, count(*) n_features, cast(floor(sum(gain) / count(*)) as bigint) weight from words join buckets using (word) join gains using (bucket) where side = 0 group by 1),
 scored as (select d.doc_id, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(d.doc_id::varchar, '')), 8))::bigint + 0.5) / 4294967296))) as bigint) score from documents d left join per_doc using (doc_id)),
 placed as (select *, n_features >= 20 may, row_number() over (partition by n_features >= 20 order by score desc, doc_id) place, count(*) filter (n_features >= 20) over () n from scored)
 select doc_id, n_features, weight, score, case when may and place <= 10 * n // 100 then place end "rank" from placed"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """Operators 1, 2, 3, 5, 7, 8, 9 and 11 have no SQL form; tests/llm holds them against brute force or held-out rows."""
    return {"op4_quality_rules": _op4_sql(), "op6_chat_format": _OP6_SQL, "op10_substring_dedup": _OP10_SQL, "op12_spelling_variants": _OP12_SQL, "op13_resample": _OP13_SQL}
