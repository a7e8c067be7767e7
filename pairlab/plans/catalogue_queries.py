"""Catalogue cleaning, scalar functions, filters, duplicates, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import evidence as E
from pairlab.functions import text as T
from pairlab.functions import vectors as V
from pairlab.operators import aggregates as A
from pairlab.operators import resolve as R
from pairlab.operators import rows as D
from pairlab.plans.registry import query
from pairlab.session import scratch_path
from pairlab.sources import fixtures as X
from pairlab.sources import readers, writers
from pairlab.sources.fixtures import ctes, sql_clean

SEQ_SQL = "upper(regexp_replace(coalesce({c}, ''), '[^A-Za-z]', '', 'g'))"
VALID_SQL = "regexp_replace(" + SEQ_SQL + ", '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"


# --- scans and sinks -----------------------------------------------------------


@query(
    "read_dirty_csv",
    ctes("catalogue") + f"""select AllergenID, {sql_clean('IsoName')} as IsoName, {sql_clean('Name')} as Name,
        {sql_clean('Common')} as Common from catalogue""",
)
def read_dirty_csv(spark, sf):
    raw = X.dirty_catalogue(spark, sf).select("AllergenID", "IsoName", "Name", "Common")
    path = scratch_path(spark, "dirty-csv")
    writers.write_table(raw.toDF(*[f"{T.NBSP}{c} " for c in raw.columns]), path, "csv")
    back = readers.read_dirty_csv(spark, path, multi_line=True)
    return back.select("AllergenID", *[T.clean_text(c).alias(c) for c in ("IsoName", "Name", "Common")])


@query(
    "read_vectors",
    """select vec_id as id, label, len(embedding) as dim, round(cast(embedding[1] as double), 6) as first_value from embeddings""",
)
def read_vectors(spark, sf):
    df = readers.read_vectors(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding", ["label"])
    return df.select("id", "label", F.size("v").cast("bigint").alias("dim"), F.round(F.get("v", F.lit(0)), 6).alias("first_value"))


@query("write_table", ctes("names") + "select id, official_name, family from names")
def write_table(spark, sf):
    path = scratch_path(spark, "names")
    writers.write_table(X.names(spark, sf), path)
    return spark.read.parquet(path)


# --- scalar functions ----------------------------------------------------------


@query("clean_text", ctes("catalogue") + f"select ord, {sql_clean('IsoName')} as name from catalogue")
def clean_text(spark, sf):
    return X.dirty_catalogue(spark, sf).select("ord", T.clean_text("IsoName").alias("name"))


@query(
    "strip_isoform",
    ctes("catalogue") + f"select ord, regexp_replace({sql_clean('IsoName')}, '\\.[0-9]+$', '') as name from catalogue",
)
def strip_isoform(spark, sf):
    return X.dirty_catalogue(spark, sf).select("ord", T.strip_isoform("IsoName").alias("name"))


@query("base_name", ctes("catalogue") + f"select ord, split_part({sql_clean('IsoName')}, '.', 1) as name from catalogue")
def base_name(spark, sf):
    return X.dirty_catalogue(spark, sf).select("ord", T.base_name("IsoName").alias("name"))


@query("clean_sequence", ctes("catalogue") + f"select ord, {SEQ_SQL.format(c='Sequence')} as seq from catalogue")
def clean_sequence(spark, sf):
    return X.dirty_catalogue(spark, sf).select("ord", T.clean_sequence("Sequence").alias("seq"))


@query("valid_residues", ctes("catalogue") + f"select ord, {VALID_SQL.format(c='Sequence')} as seq from catalogue")
def valid_residues(spark, sf):
    return X.dirty_catalogue(spark, sf).select("ord", T.valid_residues("Sequence").alias("seq"))


@query(
    "make_id",
    ctes("catalogue") + """select ord, case when IsoAllergenID = '' then 'WHO_' || AllergenID
        else 'WHO_' || AllergenID || '_ISO_' || IsoAllergenID end as entity_id,
        AllergenID || '_' || IsoAllergenID as plain_id from catalogue""",
)
def make_id(spark, sf):
    return X.dirty_catalogue(spark, sf).select(
        "ord", T.make_id("AllergenID", "IsoAllergenID").alias("entity_id"),
        T.make_plain_id("AllergenID", "IsoAllergenID").alias("plain_id"),
    )


@query("coalesce_name", ctes("names") + "select id, official_name from names")
def coalesce_name(spark, sf):
    return X.dirty_catalogue(spark, sf).select(
        F.col("ord").alias("id"), T.coalesce_name("IsoName", "Name").alias("official_name")
    )


@query(
    "join_nonempty",
    ctes("catalogue") + f"""select ord, concat_ws('; ', nullif({sql_clean('AllergenicityRef')}, ''),
        nullif({sql_clean('SequenceRef')}, '')) as reference from catalogue""",
)
def join_nonempty(spark, sf):
    return X.dirty_catalogue(spark, sf).select("ord", T.join_nonempty("AllergenicityRef", "SequenceRef").alias("reference"))


@query(
    "availability_length",
    ctes("catalogue") + f"""select ord, case when length(s) > 0 then 'Yes' else 'No' end as available, nullif(length(s), 0) as seq_length
        from (select ord, {SEQ_SQL.format(c='Sequence')} as s from catalogue)""",
)
def availability_length(spark, sf):
    seq = X.dirty_catalogue(spark, sf).select("ord", T.clean_sequence("Sequence").alias("s"))
    return seq.select("ord", T.availability("s").alias("available"), T.sequence_length("s").cast("bigint").alias("seq_length"))


@query("first_token", ctes("catalogue") + f"select ord, regexp_split_to_array({sql_clean('AccUniProt')}, '\\s+')[1] as accession from catalogue")
def first_token(spark, sf):
    return X.dirty_catalogue(spark, sf).select("ord", T.first_token("AccUniProt").alias("accession"))


@query(
    "food_keyword",
    ctes("catalogue") + "select ord, lower(split_part(trim(split_part(split_part(Common, ',', 1), '(', 1)), ' ', 1)) as keyword from catalogue",
)
def food_keyword(spark, sf):
    return X.dirty_catalogue(spark, sf).select("ord", T.food_keyword("Common").alias("keyword"))


_WEIGHT_ROWS = ", ".join(f"('{k}', {v})" for k, v in E.EVIDENCE_WEIGHTS.items())
_WEIGHTS = f"w(level, weight) as (values {_WEIGHT_ROWS})"
_BUCKET = """case when coalesce(evidence_level, '') similar to '(Confirmed|Strong).*' then 'Confirmed/Strong'
    when evidence_level like 'Suspected%' then 'Suspected' when evidence_level like 'Inferred%' then 'Inferred/family-level'
    else 'UNMAPPED' end"""
_BUCKET_WEIGHT = """case bucket when 'Confirmed/Strong' then cast(1.0 as double) when 'Suspected' then cast(0.65 as double)
    else cast(0.45 as double) end"""


@query(
    "evidence_weight",
    ctes("gold", extra=_WEIGHTS) + """select pair_id, evidence_level, cast(coalesce(w.weight, 0.5) as double) as weight
        from gold left join w on w.level = evidence_level""",
)
def evidence_weight(spark, sf):
    return E.with_evidence_weight(X.gold(spark, sf)).select("pair_id", "evidence_level", "weight")


@query("evidence_bucket", ctes("gold") + f"select pair_id, {_BUCKET} as bucket from gold")
def evidence_bucket(spark, sf):
    return X.gold(spark, sf).select("pair_id", E.evidence_bucket("evidence_level").alias("bucket"))


@query(
    "bucket_weight",
    ctes("gold") + f"select pair_id, bucket, {_BUCKET_WEIGHT} as weight from (select pair_id, {_BUCKET} as bucket from gold)",
)
def bucket_weight(spark, sf):
    b = X.gold(spark, sf).select("pair_id", E.evidence_bucket("evidence_level").alias("bucket"))
    return b.select("pair_id", "bucket", E.bucket_weight("bucket").alias("weight"))


@query(
    "round_weight",
    ctes("gold", extra=_WEIGHTS) + """select pair_id, round(cast(coalesce(w.weight, 0.5) as double) / 3, 3) as weight
        from gold left join w on w.level = evidence_level""",
)
def round_weight(spark, sf):
    return E.with_evidence_weight(X.gold(spark, sf)).select("pair_id", F.round(F.col("weight") / 3, 3).alias("weight"))


@query("canonical_pair", ctes("raw_pairs") + "select pair_id, least(name_1, name_2) as id_a, greatest(name_1, name_2) as id_b from raw_pairs")
def canonical_pair(spark, sf):
    return D.canonical_pair(X.raw_pairs(spark, sf), "name_1", "name_2").select("pair_id", "id_a", "id_b")


@query(
    "vector_norm",
    ctes("vectors") + """select count(*) as n, round(avg(norm), 6) as mean_norm, round(stddev_pop(norm), 6) as std_norm,
        round(min(norm), 6) as min_norm, round(max(norm), 6) as max_norm, bool_and(abs(norm - 1) <= 1e-3) as all_unit
        from (select sqrt(list_dot_product(v, v)) as norm from vectors)""",
)
def vector_norm(spark, sf):
    n = X.vectors(spark, sf).select(V.l2_norm("v").alias("norm"))
    return n.agg(
        F.count("*").alias("n"), F.round(F.avg("norm"), 6).alias("mean_norm"), F.round(F.stddev_pop("norm"), 6).alias("std_norm"),
        F.round(F.min("norm"), 6).alias("min_norm"), F.round(F.max("norm"), 6).alias("max_norm"),
        F.bool_and(V.is_unit(F.col("norm"))).alias("all_unit"),
    )


# --- filters -------------------------------------------------------------------


@query("nonempty_sequence", ctes("catalogue") + f"select ord from catalogue where {SEQ_SQL.format(c='Sequence')} <> ''")
def nonempty_sequence(spark, sf):
    seq = X.dirty_catalogue(spark, sf).select("ord", T.clean_sequence("Sequence").alias("seq"))
    return D.nonempty_sequence(seq).select("ord")


@query(
    "min_length",
    ctes("catalogue") + f"""select ord, length(s) as n from (select ord, {VALID_SQL.format(c='Sequence')} as s from catalogue)
        where length(s) = 0 or length(s) >= 30""",
)
def min_length(spark, sf):
    seq = X.dirty_catalogue(spark, sf).select("ord", T.valid_residues("Sequence").alias("seq"))
    return D.min_length(seq).select("ord", F.length("seq").cast("bigint").alias("n"))


@query("has_vector", ctes("names") + "select id, official_name from names where id in (select vec_id from embeddings)")
def has_vector(spark, sf):
    return D.has_key(X.names(spark, sf), X.vectors(spark, sf), "id").select("id", "official_name")


@query("missing_vector", ctes("names") + "select id, official_name from names where id not in (select vec_id from embeddings)")
def missing_vector(spark, sf):
    return D.missing_key(X.names(spark, sf), X.vectors(spark, sf), "id").select("id", "official_name")


@query(
    "evidence_exclude_regex",
    ctes("raw_pairs") + """select pair_id, evidence_level from raw_pairs
        where not coalesce(regexp_matches(evidence_level, 'negative|Contested|Risky|NO cross', 'i'), false)""",
)
def evidence_exclude_regex(spark, sf):
    return E.exclude_by_regex(X.raw_pairs(spark, sf)).select("pair_id", "evidence_level")


_PREFIX_SQL = """not (coalesce(evidence_level, '') like 'Reported negative%' or coalesce(evidence_level, '') like 'Reported NO cross-reactivity%'
    or coalesce(evidence_level, '') like 'Reported low/weak%' or coalesce(evidence_level, '') like 'Risky/Contested%'
    or coalesce(evidence_level, '') like 'Suspected/Contested%')"""


@query("evidence_exclude_prefix", ctes("raw_pairs") + f"select pair_id, evidence_level from raw_pairs where {_PREFIX_SQL}")
def evidence_exclude_prefix(spark, sf):
    return E.exclude_by_prefix(X.raw_pairs(spark, sf)).select("pair_id", "evidence_level")


def _with_text(spark, sf):
    docs = readers.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return X.names(spark, sf).join(docs, "id", "left_semi")


@query(
    "coverage_gap",
    ctes("raw_pairs", extra="e as (select split_part(name_1, '.', 1) as entity from raw_pairs union select split_part(name_2, '.', 1) from raw_pairs)")
    + """select entity from e where entity not in (select split_part(official_name, '.', 1) from names where id in (select doc_id from documents)
        and id in (select ord from catalogue where AllergenicityRef is not null))""",
)
def coverage_gap(spark, sf):
    """Names in pairs without a catalogue entry that has a text and a reference."""
    pairs = X.raw_pairs(spark, sf).select(T.base_name("name_1").alias("a"), T.base_name("name_2").alias("b"))
    cited = X.dirty_catalogue(spark, sf).filter("AllergenicityRef is not null").select(F.col("ord").alias("id"))
    known = _with_text(spark, sf).join(cited, "id", "left_semi").select(T.base_name("official_name").alias("official_name"))
    return D.coverage_gap(pairs, "a", "b", known, "official_name")


@query(
    "known_endpoints",
    ctes("raw_pairs", extra="k as (select distinct official_name from names where id in (select doc_id from documents))")
    + "select pair_id, name_1, name_2 from raw_pairs where name_1 in (from k) and name_2 in (from k)",
)
def known_endpoints(spark, sf):
    """Both ends are catalogue entries with a text."""
    return D.known_endpoints(X.raw_pairs(spark, sf), _with_text(spark, sf), "official_name", "name_1", "name_2").select("pair_id", "name_1", "name_2")


@query(
    "drop_self_pairs",
    ctes("raw_pairs", extra="m as (select official_name as name, min(id) as id from names group by 1)")
    + "select pair_id from raw_pairs join m x on x.name = name_1 join m y on y.name = name_2 where x.id <> y.id",
)
def drop_self_pairs(spark, sf):
    """Names become ids first; several names of one entity are one id."""
    ids = R.name_to_id(X.names(spark, sf), "official_name", "id", "id")
    mapped = R.map_pairs(X.raw_pairs(spark, sf), "name_1", "name_2", ids)
    return D.drop_self_pairs(mapped, "id_1", "id_2").select("pair_id")


# --- duplicates, sorts, unions -------------------------------------------------


@query("dedup_rows", ctes("catalogue") + "select distinct Species, Common, SequenceRef from catalogue")
def dedup_rows(spark, sf):
    return D.dedup_rows(X.dirty_catalogue(spark, sf).select("Species", "Common", "SequenceRef"))


@query(
    "dedup_subset_first",
    ctes("catalogue") + f"""select ord, name, AccUniProt, seq from (select *, row_number() over (partition by name, AccUniProt, seq order by ord) rn
        from (select ord, {sql_clean('Name')} as name, AccUniProt, coalesce(Sequence, '') as seq from catalogue)) where rn = 1""",
)
def dedup_subset_first(spark, sf):
    cat = X.dirty_catalogue(spark, sf).select(
        "ord", T.clean_text("Name").alias("name"), "AccUniProt", F.coalesce("Sequence", F.lit("")).alias("seq")
    )
    return D.first_per_key(cat, ["name", "AccUniProt", "seq"], ["ord"])


@query(
    "dedup_sequence",
    ctes("catalogue") + f"""select min(ord) as ord, seq from (select ord, {VALID_SQL.format(c='Sequence')} as seq from catalogue) group by seq""",
)
def dedup_sequence(spark, sf):
    seq = X.dirty_catalogue(spark, sf).select("ord", T.valid_residues("Sequence").alias("seq"))
    return D.first_per_key(seq, ["seq"], ["ord"])


@query(
    "dedup_unordered_pair",
    ctes("raw_pairs") + """select pair_id, name_1, name_2 from (select *, row_number() over
        (partition by least(name_1, name_2), greatest(name_1, name_2) order by pair_id) rn from raw_pairs) where rn = 1""",
)
def dedup_unordered_pair(spark, sf):
    pairs = X.raw_pairs(spark, sf).select("pair_id", "name_1", "name_2")
    return D.dedup_unordered_pair(pairs, "name_1", "name_2", ["pair_id"])


@query("sort_table", ctes("names") + "select official_name, id from names order by official_name, id")
def sort_table(spark, sf):
    return D.sort_table(X.names(spark, sf).select("official_name", "id"), "official_name", "id")


@query("head_sample", ctes("names") + "select official_name, id from names order by official_name, id limit 20")
def head_sample(spark, sf):
    return D.head_sample(X.names(spark, sf).select("official_name", "id"), ["official_name", "id"], 20)


@query("union_endpoints", ctes("raw_pairs") + "select name_1 as entity from raw_pairs union select name_2 from raw_pairs")
def union_endpoints(spark, sf):
    return D.union_endpoints(X.raw_pairs(spark, sf), "name_1", "name_2")


@query(
    "union_labelled",
    ctes("gold", "documented") + """select id_1, id_2, 1 as label, 'positive' as pair_type from gold
        union all select id_1, id_2, 0, 'negative_documented' from documented""",
)
def union_labelled(spark, sf):
    pos = X.gold(spark, sf).select("id_1", "id_2", F.lit(1).alias("label"), F.lit("positive").alias("pair_type"))
    neg = X.documented_negatives(spark, sf).select("id_1", "id_2", F.lit(0).alias("label"), F.lit("negative_documented").alias("pair_type"))
    return D.union_labelled(pos, neg)


# --- joins and resolution ------------------------------------------------------


@query(
    "first_match_enrich",
    ctes("names", "enrichment") + """select n.id, n.official_name, coalesce(e.grp, '') as grp, coalesce(e.reference, '') as reference from
        (select id, official_name, regexp_replace(official_name, '\\.[0-9]+$', '') as m from names) n
        left join (select * from (select *, row_number() over (partition by match_name order by ord) rn from enrichment) where rn = 1) e on e.match_name = n.m""",
)
def first_match_enrich(spark, sf):
    left = X.names(spark, sf).select("id", "official_name", T.strip_isoform("official_name").alias("match_name"))
    return R.first_match_enrich(left, X.enrichment(spark, sf), "match_name", "ord", ["grp", "reference"]).drop("match_name")


_REPS = "reps as (select split_part(official_name, '.', 1) as base, min(official_name) as official_name from names group by 1)"


@query("isoform_representative", ctes("names", extra=_REPS) + "select base, official_name from reps")
def isoform_representative(spark, sf):
    return R.isoform_representative(X.names(spark, sf), "official_name")


@query(
    "resolve_gold",
    ctes("raw_pairs", extra=_REPS)
    + """select pair_id, b1 as name_1, b2 as name_2, x.official_name as resolved_1, y.official_name as resolved_2
        from (select pair_id, split_part(name_1, '.', 1) as b1, split_part(name_2, '.', 1) as b2 from raw_pairs)
        join reps x on x.base = b1 join reps y on y.base = b2""",
)
def resolve_gold(spark, sf):
    raw = X.raw_pairs(spark, sf).select("pair_id", T.base_name("name_1").alias("name_1"), T.base_name("name_2").alias("name_2"))
    reps = R.isoform_representative(X.names(spark, sf), "official_name")
    return R.resolve_gold(raw, "name_1", "name_2", reps)


@query("name_to_id_first", ctes("names") + "select official_name as name, min(id) as id from names where official_name <> '' and lower(official_name) <> 'nan' group by 1")
def name_to_id_first(spark, sf):
    return R.name_to_id(X.names(spark, sf), "official_name", "id", "id")


@query("name_to_id_last", ctes("names") + "select official_name as name, max(id) as id from names where official_name <> '' and lower(official_name) <> 'nan' group by 1")
def name_to_id_last(spark, sf):
    return R.name_to_id(X.names(spark, sf), "official_name", "id", "id", mode="last")


@query(
    "resolve_exact_then_base",
    ctes("names") + """, k as (select official_name as key, min(id) as ord from names group by 1),
        b as (select split_part(key, '.', 1) as base, min_by(key, ord) as key from k group by 1),
        q as (select distinct p_brand || ' ' || p_name as name from part)
        select q.name, coalesce(k.key, b.key) as resolved from q left join k on k.key = q.name left join b on b.base = q.name""",
)
def resolve_exact_then_base(spark, sf):
    names = X.names(spark, sf)
    keys = names.groupBy(F.col("official_name").alias("key")).agg(F.min("id").alias("ord"))
    wanted = readers.read_table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("name")).distinct()
    return R.resolve_exact_then_base(wanted, "name", keys, "key", "ord")


_MAP = "m as (select official_name as name, min(id) as id from names where id in (select doc_id from documents) group by 1)"


@query(
    "map_pairs",
    ctes("raw_pairs", extra=_MAP) + "select pair_id, x.id as id_1, y.id as id_2 from raw_pairs join m x on x.name = name_1 join m y on y.name = name_2",
)
def map_pairs(spark, sf):
    names = R.name_to_id(_with_text(spark, sf), "official_name", "id", "id")
    return R.map_pairs(X.raw_pairs(spark, sf), "name_1", "name_2", names).select("pair_id", "id_1", "id_2")


@query(
    "map_report",
    ctes("raw_pairs", extra=_MAP) + """select count(*) filter (x.id is not null and y.id is not null) as n_mapped,
        count(*) filter (x.id is null or y.id is null) as n_missing
        from raw_pairs left join m x on x.name = name_1 left join m y on y.name = name_2""",
)
def map_report(spark, sf):
    names = R.name_to_id(_with_text(spark, sf), "official_name", "id", "id")
    return R.map_report(X.raw_pairs(spark, sf), "name_1", "name_2", names)


@query(
    "family_map",
    ctes("gold") + """select entity, min_by(family, (ord, side)) as family from (select pair_id as ord, 0 as side, id_1 as entity, family_1 as family from gold
        union all select pair_id, 1, id_2, family_1 from gold) group by entity""",
)
def family_map(spark, sf):
    return R.family_map(X.gold(spark, sf), "id_1", "id_2", "family_1", "family_2", "pair_id")


@query(
    "family_map_own_side",
    ctes("gold") + """select entity, min_by(family, (ord, side)) as family from (select pair_id as ord, 0 as side, id_1 as entity, family_1 as family from gold
        union all select pair_id, 1, id_2, family_2 from gold) group by entity""",
)
def family_map_own_side(spark, sf):
    return R.family_map(X.gold(spark, sf), "id_1", "id_2", "family_1", "family_2", "pair_id", own_side=True)


# --- aggregations --------------------------------------------------------------


@query(
    "dq_report",
    ctes("catalogue") + f"""select count(*) as n_rows, cast(sum(n - 1) as bigint) as n_duplicates,
        count(*) filter (acc = '') as n_missing_acc, count(*) filter (ref = '') as n_missing_ref
        from (select {sql_clean('Name')} as name, AccUniProt as acc, SequenceRef as ref, count(*) as n from catalogue group by all)""",
)
def dq_report(spark, sf):
    cat = X.dirty_catalogue(spark, sf).select(T.clean_text("Name").alias("name"), F.col("AccUniProt").alias("acc"), F.col("SequenceRef").alias("ref"))
    return A.dq_report(cat, ["name", "acc", "ref"], ["acc", "ref"])


@query(
    "length_stats",
    ctes("sequences") + """select count(*) as n_rows, count(*) filter (length(seq) = 0) as n_empty, round(avg(length(seq)), 6) as mean_length,
        max(length(seq)) as max_length, min(length(seq)) as min_length from sequences""",
)
def length_stats(spark, sf):
    s = A.length_stats(X.sequences(spark, sf), "seq")
    return s.select("n_rows", "n_empty", F.round("mean_length", 6).alias("mean_length"), F.col("max_length").cast("bigint"), F.col("min_length").cast("bigint"))


_DESCRIBE = """count({v}) as n, round(avg({v}), 6) as mean, round(stddev_samp({v}), 6) as std, round(min({v}), 6) as min,
    round(max({v}), 6) as max, round(quantile_cont({v}, 0.25), 6) as q25, round(quantile_cont({v}, 0.5), 6) as q50,
    round(quantile_cont({v}, 0.75), 6) as q75"""


def _rounded(df, *keys):
    return df.select(*keys, *[c if c == "n" else F.round(c, 6).alias(c) for c in df.columns if c not in keys])


@query("describe", ctes("scored") + f"select {_DESCRIBE.format(v='score')} from scored")
def describe(spark, sf):
    return _rounded(A.describe(X.scored_pairs(spark, sf), "score"))


@query("describe_by_group", f"select l_returnflag, {_DESCRIBE.format(v='l_extendedprice')} from lineitem group by 1")
def describe_by_group(spark, sf):
    return _rounded(A.describe(readers.read_table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]), "l_returnflag")


@query(
    "bucket_share",
    ctes("raw_pairs") + f"""select bucket, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share
        from (select {_BUCKET} as bucket from raw_pairs) group by bucket""",
)
def bucket_share(spark, sf):
    return A.bucket_share(X.raw_pairs(spark, sf)).withColumn("share", F.round("share", 6))


@query("status_counts", "select o_orderstatus as status, count(*) as n from orders group by 1")
def status_counts(spark, sf):
    return A.status_counts(readers.read_table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"), "status")


@query(
    "histogram",
    ctes("scored") + """, r as (select label, min(score) as lo, max(score) as hi, (max(score) - min(score)) / 20 as w from scored group by 1)
        select label, cast(least(floor((score - lo) / w), 19) as integer) as bin, count(*) as n,
        round(lo + least(floor((score - lo) / w), 19) * w, 6) as bin_start, round(lo + (least(floor((score - lo) / w), 19) + 1) * w, 6) as bin_end
        from scored join r using (label) group by all""",
)
def histogram(spark, sf):
    h = A.histogram(X.scored_pairs(spark, sf), "score", "label")
    return h.select("label", "bin", "n", F.round("bin_start", 6).alias("bin_start"), F.round("bin_end", 6).alias("bin_end"))


_LONG = """select id, cast(dim - 1 as integer) as dim, round({agg}(x), 6) as value from
    (select id, generate_subscripts(v, 1) as dim, unnest(v) as x from tokens) group by all"""


def _pooled(df):
    return df.select("id", F.posexplode("v").alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("value"))


@query("mean_pool", ctes("tokens") + _LONG.format(agg="avg"))
def mean_pool(spark, sf):
    return _pooled(A.pool_tokens(X.token_vectors(spark, sf), "mean"))


@query("max_pool", ctes("tokens") + _LONG.format(agg="max"))
def max_pool(spark, sf):
    return _pooled(A.pool_tokens(X.token_vectors(spark, sf), "max"))


@query(
    "trim_special_tokens",
    ctes("tokens") + """select id, pos - 1 as pos, round(v[1], 6) as first_value from (select *, count(*) over (partition by id) as n from tokens)
        where pos >= 1 and pos <= n - 2""",
)
def trim_special_tokens(spark, sf):
    t = A.trim_special_tokens(X.token_vectors(spark, sf))
    return t.select("id", "pos", F.round(F.get("v", F.lit(0)), 6).alias("first_value"))


@query(
    "length_summary",
    ctes("tokens") + """select count(*) as n_entities, min(n) as min_tokens, round(avg(n), 6) as mean_tokens, max(n) as max_tokens
        from (select id, count(*) as n from tokens group by id)""",
)
def length_summary(spark, sf):
    return A.length_summary(X.token_vectors(spark, sf)).withColumn("mean_tokens", F.round("mean_tokens", 6))
