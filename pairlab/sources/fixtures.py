"""Entity, pair, vector and token tables derived from the given test tables.

Each table has a SQL twin in ``SQL`` (used by the oracle queries). All are whole
tables: no sampling, no row caps, no shortened texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.functions import vectors as V
from pairlab.functions.text import NBSP, clean_sequence, coalesce_name
from pairlab.sources.readers import read_table, read_vectors

# Evidence text by label of the first entity; label 7 has none.
LABEL_EVIDENCE = [
    "Confirmed",
    "Strong evidence",
    "Suspected",
    "Suspected (homology-based)",
    "Inferred (family-level homology)",
    "Risky/Contested",
    "Reported low/weak",
    None,
    "Reported negative",
    "Confirmed (partial epitope overlap)",
]


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """id, v, family."""
    df = read_vectors(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding", ["label"])
    return df.select("id", "v", F.col("label").cast("string").alias("family"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring ids whose vectors point the same way: chains of pairs."""
    a = read_vectors(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding", ["label"])
    left = a.select(F.col("id").alias("id_1"), F.col("label").alias("l1"), F.col("v").alias("v1"), (F.col("id") + 1).alias("id_2"))
    right = a.select(F.col("id").alias("id_2"), F.col("label").alias("l2"), F.col("v").alias("v2"))
    levels = F.array(*[F.lit(x) for x in LABEL_EVIDENCE])
    return (
        left.join(right, "id_2")
        .filter(V.dot("v1", "v2") > 0)
        .select(
            F.col("id_1").alias("pair_id"),
            "id_1",
            "id_2",
            F.col("l1").cast("string").alias("family_1"),
            F.col("l2").cast("string").alias("family_2"),
            F.get(levels, F.col("l1")).alias("evidence_level"),
        )
    )


def dirty_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Raw catalogue with non-breaking spaces, gaps and isoform suffixes."""
    part = read_table(spark, sf, "part")
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("p_partkey"), F.col("text"))
    base = F.concat_ws(" ", "p_brand", "p_name")
    size = F.col("p_size")
    iso = F.concat(F.lit(NBSP), base, F.lit("."), F.lpad(size.cast("string"), 4, "0"), F.lit(" "))
    return part.join(docs, "p_partkey", "left").select(
        F.col("p_partkey").alias("ord"),
        F.col("p_partkey").cast("string").alias("AllergenID"),
        F.when(size == 3, "").otherwise(size.cast("string")).alias("IsoAllergenID"),
        F.concat(F.lit(NBSP), base, F.lit(" ")).alias("Name"),
        F.when(size == 7, F.lit(None)).when(size == 11, F.lit("")).otherwise(iso).alias("IsoName"),
        F.concat(F.col("p_type"), F.lit(", "), F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")")).alias("Common"),
        F.col("p_name").alias("Species"),
        F.when(size == 5, "").otherwise(F.concat_ws("  ", "p_type", "p_brand")).alias("AccUniProt"),
        F.col("text").alias("Sequence"),
        F.when(size < 10, F.lit(None)).otherwise(F.concat(F.lit("ref "), F.col("p_brand"))).alias("AllergenicityRef"),
        F.when(size > 40, "").otherwise(F.col("p_type")).alias("SequenceRef"),
    )


def enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Several rows per name; the first by ``ord`` wins."""
    part = read_table(spark, sf, "part")
    return part.select(
        F.concat_ws(" ", "p_brand", "p_name").alias("match_name"),
        F.col("p_type").alias("grp"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("reference"),
        F.col("p_partkey").alias("ord"),
    )


def names(spark: SparkSession, sf: str) -> DataFrame:
    """id, official name (duplicates across ids), family."""
    cat = dirty_catalogue(spark, sf)
    return cat.select(
        F.col("ord").alias("id"),
        coalesce_name("IsoName", "Name").alias("official_name"),
        F.split("Common", ",")[0].alias("family"),
    )


def raw_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of full names: customers of consecutive orders, read as catalogue entries."""
    o = read_table(spark, sf, "orders")
    part = names(spark, sf)
    level = (
        F.when(F.col("o_orderstatus") == "P", "Reported negative finding")
        .when(F.col("o_orderpriority").startswith("1"), "Confirmed")
        .when(F.col("o_orderpriority").startswith("2"), "Suspected (homology-based)")
        .when(F.col("o_orderpriority").startswith("3"), "Reported low/weak")
        .when(F.col("o_orderpriority").startswith("4"), "Risky/Contested")
    )
    a = o.select(F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("k1"), level.alias("evidence_level"))
    b = o.select((F.col("o_orderkey") - 1).alias("pair_id"), F.col("o_custkey").alias("k2"))
    n1 = part.select(F.col("id").alias("k1"), F.col("official_name").alias("name_1"), F.col("family").alias("family_1"))
    n2 = part.select(F.col("id").alias("k2"), F.col("official_name").alias("name_2"), F.col("family").alias("family_2"))
    return (
        a.join(b, "pair_id").join(n1, "k1").join(n2, "k2")
        .select("pair_id", "name_1", "name_2", "family_1", "family_2", "evidence_level")
    )


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Letters of whole documents."""
    d = read_table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), clean_sequence("text").alias("seq"), F.col("lang").alias("family"))


def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Ten consecutive vectors are the tokens of one entity."""
    e = read_vectors(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding")
    ent = F.floor(F.col("id") / 10).cast("bigint")
    return e.select(ent.alias("id"), (F.col("id") - ent * 10).cast("int").alias("pos"), "v")


def documented_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring ids of different labels whose vectors point apart."""
    a = read_vectors(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding", ["label"])
    left = a.select(F.col("id").alias("id_1"), F.col("label").alias("l1"), F.col("v").alias("v1"), (F.col("id") + 1).alias("id_2"))
    right = a.select(F.col("id").alias("id_2"), F.col("label").alias("l2"), F.col("v").alias("v2"))
    return (
        left.join(right, "id_2")
        .filter((V.dot("v1", "v2") < -0.1) & (F.col("l1") != F.col("l2")))
        .select("id_1", "id_2", F.lit("Reported negative").alias("finding_type"))
    )


def scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of every (id, id + 1) and (id, id + 2); label 1 for the nearer neighbour."""
    v = read_vectors(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding")
    left = v.select(F.col("id").alias("id_1"), F.col("v").alias("v1"), F.explode(F.array(F.lit(1), F.lit(2))).alias("step"))
    left = left.withColumn("id_2", F.col("id_1") + F.col("step"))
    right = v.select(F.col("id").alias("id_2"), F.col("v").alias("v2"))
    return left.join(right, "id_2").select(
        "id_1", "id_2", F.round(V.cosine("v1", "v2"), 6).alias("score"), F.when(F.col("step") == 1, 1).otherwise(0).alias("label")
    )


# --- SQL twins -----------------------------------------------------------------

_EVIDENCE_LIST = "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in LABEL_EVIDENCE) + "]"
_CLEAN = "regexp_replace(replace(coalesce({c}, ''), chr(160), ' '), '^\\s+|\\s+$', '', 'g')"


def sql_clean(c: str) -> str:
    return _CLEAN.format(c=c)


def _draw(*parts: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) as bigint)"


SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "vectors": ((), "select vec_id as id, cast(embedding as double[]) as v, cast(label as varchar) as family from embeddings"),
    "gold": (
        (),
        f"""select a.vec_id as pair_id, a.vec_id as id_1, b.vec_id as id_2, cast(a.label as varchar) as family_1,
            cast(b.label as varchar) as family_2, ({_EVIDENCE_LIST})[a.label + 1] as evidence_level
            from embeddings a join embeddings b on b.vec_id = a.vec_id + 1
            where list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) > 0""",
    ),
    "catalogue": (
        (),
        """select p_partkey as ord, cast(p_partkey as varchar) as AllergenID,
            case when p_size = 3 then '' else cast(p_size as varchar) end as IsoAllergenID,
            chr(160) || p_brand || ' ' || p_name || ' ' as Name,
            case when p_size = 7 then null when p_size = 11 then ''
                 else chr(160) || p_brand || ' ' || p_name || '.' || lpad(cast(p_size as varchar), 4, '0') || ' ' end as IsoName,
            p_type || ', ' || p_name || ' (' || p_brand || ')' as Common, p_name as Species, p_type,
            case when p_size = 5 then '' else p_type || '  ' || p_brand end as AccUniProt, text as Sequence,
            case when p_size < 10 then null else 'ref ' || p_brand end as AllergenicityRef,
            case when p_size > 40 then '' else p_type end as SequenceRef
            from part left join documents on doc_id = p_partkey""",
    ),
    "enrichment": (
        (),
        """select p_brand || ' ' || p_name as match_name, p_type as grp, 'size ' || cast(p_size as varchar) as reference, p_partkey as ord
            from part""",
    ),
    "names": (
        ("catalogue",),
        f"""select ord as id, coalesce(nullif({sql_clean('IsoName')}, ''), {sql_clean('Name')}) as official_name, p_type as family from catalogue""",
    ),
    "raw_pairs": (
        ("names",),
        """select a.o_orderkey as pair_id, n1.official_name as name_1, n2.official_name as name_2, n1.family as family_1, n2.family as family_2,
            case when a.o_orderstatus = 'P' then 'Reported negative finding' when a.o_orderpriority like '1%' then 'Confirmed'
                 when a.o_orderpriority like '2%' then 'Suspected (homology-based)' when a.o_orderpriority like '3%' then 'Reported low/weak'
                 when a.o_orderpriority like '4%' then 'Risky/Contested' end as evidence_level
            from orders a join orders b on b.o_orderkey = a.o_orderkey + 1
            join names n1 on n1.id = a.o_custkey join names n2 on n2.id = b.o_custkey""",
    ),
    "sequences": ((), "select doc_id as id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as seq, lang as family from documents"),
    "tokens": (
        (),
        """select cast(floor(vec_id / 10) as bigint) as id, cast(vec_id - 10 * cast(floor(vec_id / 10) as bigint) as integer) as pos,
            cast(embedding as double[]) as v from embeddings""",
    ),
    "documented": (
        (),
        """select a.vec_id as id_1, b.vec_id as id_2, 'Reported negative' as finding_type
            from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 and a.label <> b.label
            where list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) < -0.1""",
    ),
    "scored": (
        ("vectors",),
        """select a.id as id_1, b.id as id_2, round(list_cosine_similarity(a.v, b.v), 6) as score, case when s.step = 1 then 1 else 0 end as label
            from vectors a, (values (1), (2)) s(step), vectors b where b.id = a.id + s.step""",
    ),
}


def ctes(*wanted: str, extra: str = "") -> str:
    """``with a as (...), b as (...)`` for the wanted tables and what they need."""
    done: list[str] = []

    def add(name: str) -> None:
        for dep in SQL[name][0]:
            add(dep)
        if name not in done:
            done.append(name)

    for w in wanted:
        add(w)
    body = [f"{n} as ({SQL[n][1]})" for n in done]
    if extra:
        body.append(extra)
    return "with recursive " + ", ".join(body) + " "
