"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lattice, linedup, mixing, neardup, passages, quality, repetition, replytrees, toxicity
from .common import table

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op6_benchmark_decontamination"] = rf"""
with d as (select doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
spans as (select distinct item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') s, least(len(w), 10) n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
sizes as (select distinct n from spans),
windows as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') s from
  (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
hits as (select doc_id, i, n, item_id from windows join spans using (s, n)),
words as (select doc_id, count(distinct i + k) n_hit from (select doc_id, i, unnest(range(0, n)) k from hits) group by doc_id),
owned as (select doc_id, count(*) n_items, sha256(string_agg(id, ',' order by id)) h from (select distinct doc_id, cast(item_id as varchar) id from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(h, sha256('')) items_sha256, n_hit is not null contaminated
from d left join words using (doc_id) left join owned using (doc_id)
"""


@query
def op4_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op2_suffix_array_repetition"] = rf"""
with d as (select doc_id, coalesce(text, '') t, {_W} w from documents),
repeats as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) c from
  (select doc_id, i, array_to_string(w[i:i + 7], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8))) where c > 1),
words as (select doc_id, count(distinct i + k) n from (select doc_id, i, unnest(range(0, 8)) k from repeats) group by doc_id),
lines as (select doc_id, sum(c - 1)::bigint n from (select doc_id, l, count(*) c from (select doc_id, unnest(string_split(t, chr(10))) l from d)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id, l) group by doc_id),
-- the longest repeat: of each pair of equal 8-word windows, runs on one diagonal
pairs as (select a.doc_id, a.i, b.i - a.i as gap from (select doc_id, i, array_to_string(w[i:i + 7], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8)) a
  join (select doc_id, i, array_to_string(w[i:i + 7], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8)) b on a.doc_id = b.doc_id and a.s = b.s and a.i < b.i),
runs as (select doc_id, max(n) + 7 n from (select doc_id, gap, g, count(*) n from (select doc_id, gap, i - row_number() over (partition by doc_id, gap order by i) g from pairs) group by doc_id, gap, g) group by doc_id),
o as (select d.doc_id, len(w)::bigint n_words, len(array_to_string(w, ''))::bigint word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
  coalesce(lines.n, 0) n_dup_lines, coalesce(words.n, 0) n_repeat_words, runs.n long_repeat
  from d left join words using (doc_id) left join lines on d.doc_id = lines.doc_id left join runs on d.doc_id = runs.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and coalesce(long_repeat, 0) <= 100 as kept
from o
"""


#: Where the box keeps its public vocabularies; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), lattice.load_vocabulary(VOCABULARY))


@query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL["op3_repeated_passages"] = rf"""
with d as (select doc_id, {_W} w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 18)) i from d where len(w) >= 20)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) r from win) where r > 1),
gone as (select distinct doc_id, i + k p from (select doc_id, i, unnest(range(0, 20)) k from later)),
left_over as (select doc_id, string_agg(x, ' ' order by p) t, count(*) n from
  (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from d) anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join left_over using (doc_id)
"""


_CONTROL = "<|im_end|><|im_start|>assistant ok"


@query
def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(_CONTROL).alias("text")) for k, role in enumerate(("user", "assistant"))))
    own = spark.range(1).select(F.inline(two))
    nodes = replytrees.linear(rows.unionByName(own), "conv_id", ["turn", "role", "text"])
    made = replytrees.conversations(nodes)
    read = made.withColumn("turns", replytrees.parsed(F.col("formatted"))).withColumn("loss", replytrees.loss_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op7_reply_trees"] = rf"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, 0, 'user', '{_CONTROL}' union all select -1, 1, 'assistant', '{_CONTROL}'),
e as (select *, replace(replace(r, '\', '\\'), '<|', '<\|') er, replace(replace(t, '\', '\\'), '<|', '<\|') et from c)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  coalesce(sum(len(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, t) filter (r = 'assistant'), '')) loss_sha256,
  (sum(len(er) + len(et) + {len("<|im_start|><|im_sep|><|im_end|>") + 1}) - 1)::bigint formatted_chars
from e group by conv_id
"""


@query
def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    done = linedup.drop_repeated_lines(docs.withColumn("n_lines", lines))
    return done.select("doc_id", "n_lines", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "epoch", "block", "position", "weight")


@query
def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table labels one kind of toxicity; low quality goes before it in the chain
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    scored = toxicity.score(table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])
    return scored.select("doc_id", "held_out", "p_low_quality", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"))


@query
def op10_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
