"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import brown, contamination, hardneg, langid, licenses, nearjoin, pieces, quality, quotes, sharding, spelling, substrings, warc
from pairlab.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    """Register under the function's name; ``sql`` is its twin in DuckDB."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register if fn is None else register(fn)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _em_sql() -> str:
    """Votes and expectation-maximisation over the metrics table ``m`` in DuckDB: s.s holds the shares, s.p the chances of a good vote (rule by rule, all classes)."""
    rules = list(quality.RULES.values())
    of = quality.class_numbers([kind for kind, _, _ in rules])
    n, last, w = len(rules), max(of), quality.PRIOR_ROWS
    classes, each = range(last + 1), range(n)
    votes = ",\n".join(f"case when {bad} then -1 when n_words >= {quality.LEAST_WORDS} and ({good}) then 1 else 0 end as v{k}" for k, (_, good, bad) in enumerate(rules))
    names = ", ".join(f"v{k}" for k in each)
    p = lambda k, c: f"s.p[{k * (last + 1) + c + 1}]"
    odds = [
        " + ".join([f"ln(s.s[{c + 1}] / s.s[1])", *[f"case v{k} when 1 then ln({p(k, c)} / {p(k, 0)}) when -1 then ln((1 - {p(k, c)}) / (1 - {p(k, 0)})) else 0 end" for k in each]])
        for c in classes[1:]
    ]
    parts = ", ".join(f"exp({x}) as e{c}" for c, x in enumerate(odds, 1))
    good = "1 / (1.0 + " + " + ".join(f"e{c}" for c in classes[1:]) + ")"
    g = lambda c: "n * g" if c == 0 else f"n * g * e{c}"
    share = [quality.PRIOR_GOOD, *[(1 - quality.PRIOR_GOOD) / last] * last]
    prior = [[1 - quality.PRIOR_RIGHT[1] if c == own else quality.PRIOR_RIGHT[0] for c in classes] for own in of]
    new_s = ", ".join(f"(sum({g(c)}) + {w} * {share[c]!r}) / (sum(n) + {w})" for c in classes)
    raw = ", ".join(
        f"(coalesce(sum({g(c)}) filter (v{k} = 1), 0) + {w} * {prior[k][c]!r}) / (coalesce(sum({g(c)}) filter (v{k} <> 0), 0) + {w}) as p{k}_{c}" for k in each for c in classes
    )
    tied = ", ".join(
        f"case when p{k}_{of[k]} > p{k}_0 then (p{k}_{of[k]} + p{k}_0) / 2 else p{k}_{c} end" if c in (0, of[k]) else f"p{k}_{c}" for k in each for c in classes
    )
    start = ", ".join(f"{x!r}::double" for row in prior for x in row)
    return f"""
votes as (select *, {votes} from m),
pat as (select {names}, count(*)::double as n from votes group by all),
em as (
  select 0 as step, [{", ".join(f"{x!r}::double" for x in share)}] as s, [{start}] as p
  union all
  select step + 1, s, [{tied}] from (
    select step, [{new_s}] as s, {raw}
    from (select *, {good} as g from (select s.step, pat.*, {parts} from em s, pat where s.step < {quality.ROUNDS})) group by step)),
q as (select *, {good} as quality from (select votes.*, {parts} from votes, (select * from em where step = {quality.ROUNDS}) s))"""


@query(
    sql=rf"""
with recursive d as (
  select doc_id, coalesce(text, '') as text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::varchar[]) as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
win as (select doc_id, k, array_to_string(w[k:k + 7], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 6)) as k from d)),
rep as (select doc_id, count(distinct j) as n from (
  select doc_id, unnest(range(k, k + 8)) as j from (select doc_id, k, count(*) over (partition by doc_id, x) as c from win) where c > 1) group by 1),
m as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))::bigint as n_upper,
         len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(rep.n, 0)::bigint as n_repeat_words, len(list_distinct(w))::bigint as n_distinct_words
  from d left join rep using (doc_id)),
{_em_sql()}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and quality >= {quality.GOOD_FROM} as kept,
       round(quality, 4) as quality
from q"""
)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior quality of all documents; the base check comes first."""
    judged = quality.judge(table(spark, folder, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), F.round("quality", 4).alias("quality"),
    )


@query(
    sql="""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest from p),
k as (select *, min(page_id) over (partition by payload_digest) as keep from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> keep then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> keep then keep end as refers_to
from k"""
)
def op2_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Every page goes into a bundle and is read back from there."""
    pages = table(spark, folder, "pages")
    path = scratch_path(spark, "warc")
    warc.write_bundles(warc.plan_records(pages, F.col("page_id"), F.col("url"), F.col("html")), path)
    kind = pages.schema["page_id"].dataType
    return warc.read_bundles(spark, path).select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


@query(
    sql=r"""
with recursive l0 as (
  select conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) as x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from conversations),
l1 as (select conv_id, turn, role, i, length(regexp_replace(regexp_extract(x, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) as level,
              trim(regexp_replace(x, '^(?:[ \t]*>)+', ''), ' ' || chr(9) || chr(13)) as says from l0),
l2 as (select * replace (case when level = 0 and regexp_matches(says, '^On .{1,300} wrote:$') and lead(level) over m > 0 then '' else says end as says)
       from l1 window m as (partition by conv_id, turn order by i)),
l3 as (select *, case when says <> '' and coalesce(lag(level) over m <> level or lag(says) over m = '', true) then 1 else 0 end as opens
       from l2 window m as (partition by conv_id, turn order by i)),
l4 as (select *, sum(opens) over (partition by conv_id, turn order by i) as k from l3),
p as (select conv_id, turn, k, min_by(level, i) as level, trim(regexp_replace(lower(string_agg(says, ' ' order by i)), '[^\p{L}\p{N}]+', ' ', 'g')) as says
      from l4 where k > 0 group by all),
b as (select conv_id, turn, any_value(role) as role, trim(coalesce(string_agg(says, chr(10) order by i) filter (level = 0), ''), chr(10)) as body from l2 group by 1, 2),
own as (select conv_id, turn, says from p where level = 0
        union select conv_id, turn, trim(regexp_replace(lower(unnest(string_split(body, chr(10)))), '[^\p{L}\p{N}]+', ' ', 'g')) from b
        union select conv_id, turn, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) from b),
f as (select conv_id, says, min(turn) as origin from own where says <> '' group by 1, 2),
links as (select p.conv_id, p.turn, min_by(origin, p.level * 1000000000 + k) as parent_turn, count(*) as n_linked
          from p join f on f.conv_id = p.conv_id and f.says = p.says where p.level > 0 and origin < p.turn group by 1, 2),
up as (select conv_id, turn, parent_turn as root_turn, 1::bigint as depth from links
       union all select up.conv_id, up.turn, parent_turn, depth + 1 from up join links on links.conv_id = up.conv_id and links.turn = up.root_turn),
top as (select conv_id, turn, min_by(root_turn, -depth) as root_turn, max(depth) as depth from up group by 1, 2),
n as (select conv_id, turn, count(*) as n_quotes from p where level > 0 and says <> '' group by 1, 2)
select b.conv_id, b.turn, b.role, body, parent_turn, coalesce(top.root_turn, b.turn) as root_turn, coalesce(depth, 0) as depth,
       coalesce(n_quotes, 0) as n_quotes, coalesce(n_linked, 0) as n_linked
from b left join links using (conv_id, turn) left join top using (conv_id, turn) left join n using (conv_id, turn)"""
)
def op3_quotation_links(spark: SparkSession, folder: str) -> DataFrame:
    """All messages with their reply links and their text without quotes."""
    return quotes.thread(table(spark, folder, "conversations")).select(
        "conv_id", "turn", "role", "body", "parent_turn", "root_turn", "depth", "n_quotes", "n_linked"
    )


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Dictionaries from the documents whose remainder is not 1, predictions for all."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"))
    dictionaries = langid.learn(docs.filter("not held_out and doc_id is not null"))
    return langid.identify(docs.select("doc_id", "text", "held_out"), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query(
    sql=r"""
with w as (
  select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark where text is not null),
v as (select item, words, least(10, len(words)) as size, unnest(range(1, len(words) - least(10, len(words)) + 2)) as k from w where len(words) > 0),
win as (select distinct item, size, array_to_string(words[k:k + size - 1], ' ') as win from v),
sizes as (select distinct size from win),
d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) as words
  from documents),
p as (select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as k from d, sizes),
h as (select doc_id, k, p.size, item from p join win on win.size = p.size and win.win = array_to_string(words[k:k + p.size - 1], ' ')),
hit as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(k, k + size)) as x from h) group by 1),
own as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by 1)
select d.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join own using (doc_id)"""
)
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = contamination.contaminated(docs, table(spark, folder, "benchmark"))
    n_hit = contamination.words_hit(F.col("hit_spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


@query
def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All documents to piece ids and back."""
    ids = pieces.encode(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return pieces.decode(ids).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op7_class_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from the documents whose remainder is not 2, scores all."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    docs = table(spark, folder, "documents").select("doc_id", "text", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"))
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    model = brown.fit(docs.filter("not held_out"))
    return brown.score(docs, model, "_row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


@query
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of all documents under 200-byte strings that occur again."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"))
    return substrings.remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("removed_spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.75."""
    return nearjoin.near_components(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query(
    sql="""
with recursive tab as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(256) r(i))),
d as (select doc_id, coalesce(text, '') as x from documents),
b as (select doc_id, strlen(x) + 8 as size,
             list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::bigint) as bytes from d),
c as (select doc_id, size::bigint as size,
             xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, y: xor(c >> 8, t[xor(c, y) % 256 + 1])), 4294967295)::bigint as text_crc32
      from b, tab),
s as (select *, sum(size) over (order by doc_id) - size as start, sum(size) over () as total from c),
g as (select *, least(((2 * start + size) * 24) // (2 * total), 23)::int as shard from s)
select doc_id, size, text_crc32, 'bytes' as law, shard,
       (row_number() over (partition by shard order by doc_id) - 1)::bigint as slot, null::int as grown_shard
from g"""
)
def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in doc_id order, cut into 24 shards of nearly equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.balanced_shards(docs, "size", ["doc_id", "text_crc32", "size"], 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License detections of all documents; the labels of base phrases stay beside those of the rules."""
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    labels = lambda *lists: F.array_join(F.array_sort(F.array_distinct(F.concat(*lists))), ",")
    start = F.col("base_places.start").cast("array<bigint>")
    return found.select(
        "doc_id", "n_words",
        F.size("base_places").cast("bigint").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        labels("base_places.label").alias("base_labels"),
        labels("base_places.label", "detections.label").alias("labels"),
        F.coalesce(F.array_max("detections.weight"), F.lit(0.0)).alias("score"),
    )


@query(
    sql="""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
      from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id, score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id, row_number() over w::int as rank, s.id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
window w as (partition by p.anchor_id, p.id order by s.score desc, s.id) qualify row_number() over w <= 3"""
)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """All rows as negatives of the anchors whose id is divisible by 50."""
    rows = hardneg.usable(table(spark, folder, "embeddings"), "vec_id", "label", "embedding")
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.select("id", label.alias("label"), F.transform("v", lambda x: F.floor(256 * x).cast("double")).alias("v")), F.col("id") % 50 == 0)


@query(
    sql="""
with recursive tab as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(256) r(i))),
r as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{5,}')) as run from documents),
d as (select run, coalesce(doc_id::varchar, '') || ':' || run as x, count(*) as k from r group by 1, 2),
b as (select run, k, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::bigint) as bytes from d),
h as (select run, k, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, y: xor(c >> 8, t[xor(c, y) % 256 + 1])), 4294967295)::bigint as h from b, tab),
w as (select case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, k from h),
v as (select word, sum(k)::bigint as n from w where length(word) >= 5 group by 1 having sum(k) >= 3),
g as (select word, n, i, word[:i] || word[i + 2:] as gap from (select word, n, unnest(range(length(word))) as i from v)),
near as (
  select a.word, b.word as other, b.n as m from g a join g b on a.i = b.i and a.gap = b.gap and a.word <> b.word
  union select g.word, v.word, v.n from g join v on v.word = g.gap
  union select v.word, g.word, g.n from g join v on v.word = g.gap),
best as (select word, count(*)::bigint as n_near, min({'m': -m, 'other': other}) as b from near group by 1),
f as (select v.word, n, coalesce(n_near, 0) as n_near, case when -b.m >= 2 * n then b.other end as form, case when -b.m >= 2 * n then -b.m end as form_n
      from v left join best using (word)),
up as (select word, form as root, 1 as k from f where form is not null
       union all select up.word, f.form, k + 1 from up join f on f.word = up.root where f.form is not null),
top as (select word, max_by(root, k) as root from up group by 1)
select f.word, n, n_near, form, form_n, coalesce(root, f.word) as root from f left join top using (word)"""
)
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Variants among all words of all documents; runs whose hash is divisible by 97 lose a code point first."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    cut = F.overlay("run", F.lit(""), h % F.length("run") + 1, F.lit(1))
    words = spelling.vocabulary(docs, "text", F.when(h % 97 == 0, cut).otherwise(F.col("run")))
    return spelling.group_variants(words).select("word", "n", "n_near", "form", "form_n", "root")


@query(sql=corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus pipeline over the whole table."""
    return corpus_pipeline.run(spark, folder)
