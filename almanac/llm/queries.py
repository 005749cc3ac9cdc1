"""The operators of this subpackage as queries over the supplied tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import alignment, decontaminate, interaction, jaccard, language, minhash, packing, pii, quality, substring, tokenfile, tokens, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
tri as (select doc_id, i, w[i] || chr(1) || w[i+1] || chr(1) || w[i+2] as k
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) as c from tri) where c > 1),
cov as (select doc_id, count(distinct i + j) as n_repeat_words
  from rep, (select unnest([0, 1, 2]) as j) group by doc_id),
lines as (select doc_id, l from (select doc_id, unnest(string_split(text, chr(10))) as l from d)
  where regexp_matches(l, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from lines group by doc_id),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
  coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join dup using (doc_id) left join cov using (doc_id)),
l as (select *, cast(
    (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when 100 * n_symbols > 30 * n_words then 4 else 0 end) + (case when 100 * n_dup_lines > 40 * n_lines then 8 else 0 end)
    + (case when word_chars < 2 * n_words or word_chars > 15 * n_words then 16 else 0 end) as bigint) as failures from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failures & 3 <> 0 as base_failed, failures = 0 as kept, failures, 1 as policy_version from l"""


@query("op9_quality_rules", OP9_SQL)
def op9(spark, sf_dir):
    entries = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures", "policy_version"
    )


_PATTERN_SQL = " ".join(
    f"when regexp_matches(lower(url), '{r.pattern}') then '{r.verdict}'" for r in sorted(urls.PATTERN_RULES, key=lambda r: r.verdict)
)
OP10_SQL = rf"""
with p as (select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r as (select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from h)
select page_id, host, path, rule, case rule when 'example.net/en/' then 'allow' when 'example.com/de/' then 'block'
  when 'org/fr/' then 'allow' when 'net/' then 'block' else case {_PATTERN_SQL} else 'allow' end end as verdict from r"""


@query("op10_url_filters", OP10_SQL)
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


@query("op4_toxicity")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(3, 1))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", toxicity.held_out(3, 1).alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending")
    )


@query("op8_language_id")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = toxicity.held_out(4, 2)
    model = language.fit(docs.where(~held).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query("op5_token_files")
def op5(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    tokenfile.write(table(spark, sf_dir, "documents"), path, tokens.tokenizer_path("byte_bpe_50k.json"))
    return tokenfile.read(spark, path)


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingle_sql(table_name: str, key: str, width: int = 5) -> str:
    """Distinct shingles of a table's texts; a shorter text is one shingle."""
    return rf"""select distinct {key}, case when len(w) < {width} then array_to_string(w, ' ')
      else array_to_string(w[i:i+{width - 1}], ' ') end as s
    from (select {key}, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) as i
      from (select {key}, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from {table_name}) where len(w) > 0)"""


OP3_SQL = f"""
with i as ({_shingle_sql('benchmark', 'item_id')}), d as ({_shingle_sql('documents', 'doc_id')}),
n as (select item_id, count(*) as n_shingles from i group by item_id),
f as (select doc_id, item_id, count(*) as n_found from d join i using (s) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_found from f join n using (item_id) where 100 * n_found >= 80 * n_shingles"""


@query("op3_benchmark_decontamination", OP3_SQL)
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("matches"))


_REMOVED_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i+34], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by s) as c from win) where c > 1),
gone as (select distinct doc_id, i + j as k from rep, (select unnest(range(35)) as j)),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as k from d),
kept as (select doc_id, string_agg(x, ' ' order by k) as kept, count(*) as n from words anti join gone using (doc_id, k) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (doc_id)"""


@query("op1_substring_dedup", _REMOVED_SQL)
def op1(spark, sf_dir):
    found = substring.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))



def _component_sql(width: int) -> str:
    return f"""
with recursive s as ({_shingle_sql('documents', 'doc_id', width)}),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b using (s) where a.doc_id < b.doc_id group by all),
l as (select x, y from i join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 80 * (p.n + q.n - k)),
e as (select x, y from l union all select y, x from l),
r(doc_id, z) as (select doc_id, doc_id from documents union select r.doc_id, e.y from r join e on e.x = r.z)
select doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(z) as component_id
from r left join n using (doc_id) group by doc_id"""


@query("op6_ngram_jaccard_join", _component_sql(5))
def op6(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op7_pii")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs))
    return found.select(
        "doc_id",
        *[pii.count_of(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.listed("base"), 256).alias("base_sha256"),
        pii.listed("spans").alias("spans"),
    )


OP11_SQL = rf"""
with recursive w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, {_WORDS} as w,
    min(doc_id) over (partition by coalesce(text, '')) as lowest from documents),
m as (select doc_id, part, (case when len(w) < 100 then 1 else 0 end)
    + (case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end)
    + (case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) then 4 else 0 end)
    + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when doc_id > lowest then 16 else 0 end) as mask from w),
c as (select part, mask, count(*) as n, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as tox
  from m left join labels using (doc_id) group by part, mask),
letters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p(prefix, before, letter, bit) as (select letter, 0, letter, bit from letters
  union all select prefix || l.letter, before | p.bit, l.letter, l.bit from p join letters l on (before | p.bit) & l.bit = 0),
s as (select part, prefix, letter,
    coalesce(sum(n) filter (where mask & (before | bit) = 0), 0) as kept,
    coalesce(sum(n) filter (where mask & bit <> 0 and mask & before = 0), 0) as removed,
    coalesce(sum(n) filter (where mask & bit <> 0 and mask & before <> 0), 0) as redundant,
    coalesce(sum(n) filter (where mask = bit), 0) as unique_fails,
    coalesce(sum(good) filter (where mask & bit <> 0 and mask & before = 0), 0) as good_lost,
    coalesce(sum(tox) filter (where mask & bit <> 0 and mask & before = 0), 0) as toxic_lost
  from c, p group by part, prefix, letter, before, bit),
o as (select prefix as filter_order from p where length(prefix) = 5)
select part, filter_order, cast(length(prefix) as integer) as step, letter as filter, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from o join s on starts_with(filter_order, prefix)"""


@query("op11_filter_interaction", OP11_SQL)
def op11(spark, sf_dir):
    counted = interaction.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interaction.audit(counted)


@query("op13_tokenizer_alignment")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("piece_bpe_32k.model"))


@query("op12_minhash_near_dedup", f"select *, doc_id = component_id as kept from ({_component_sql(4)})")
def op12(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))
