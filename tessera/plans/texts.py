"""Queries over sources, sinks, and cleaning of names and addresses, each with its SQL.

Names and addresses are made of the driver's tables: a part's name with a legal form, a title or an alias by its number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import changes, fixed
from ..functions import cleaning as C
from ..sources import tables
from .registry import _t, pairs, pairs2, query

# --- sources and sinks -----------------------------------------------------------------------------------------------


def _tsv(spark, d):
    path = tables.scratch(spark)
    tables.write_tsv(_t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path)
    return path


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def src_tsv(spark, d):
    return tables.read_tsv(spark, _tsv(spark, d))


@query("SELECT c_mktsegment, c_custkey FROM customer")
def src_tsv_typed(spark, d):
    """Two of four columns, in another order, one of another type."""
    return tables.read_tsv(spark, _tsv(spark, d), ["c_mktsegment", "c_custkey"], {"c_custkey": "long"})


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 25")
def src_parquet(spark, d):
    return _t(spark, d, "part").select("p_partkey", "p_name", "p_size").where("p_size > 25").select("p_partkey", "p_name")


@query("SELECT count(*) AS n FROM lineitem")
def src_rowcount(spark, d):
    """No column is read: the counts come from the footers."""
    return _t(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT q, s, country FROM pairs WHERE country IN ('c1', 'c2')")
def src_chunks(spark, d):
    path = tables.scratch(spark)
    pairs(spark, d).select("q", "s", "country").write.partitionBy("country").parquet(path)
    return tables.read_chunks(spark, path, "country=c[12]").select("q", "s", "country")


@query("SELECT q, s, p, country FROM pairs WHERE country IN ('c0', 'c1', 'c2')")
def sink_resume(spark, d):
    """Two partitions are there when the write goes on; the third is added and the two stay as they are."""
    path, t = tables.scratch(spark), pairs(spark, d).select("q", "s", "p", "country")
    tables.write_missing(t, path, "country", ["c0", "c1"])
    tables.write_missing(t.where("country <> 'c0'"), path, "country", ["c0", "c1", "c2"])
    return tables.read_chunks(spark, path, "country=*").select("q", "s", "p", F.col("country").cast("string").alias("country"))


@query("SELECT q, s, p, country FROM pairs WHERE country <> 'c3' UNION ALL SELECT q, s, p, 'c3' FROM pairs2 WHERE q % 5 = 3")
def reuse_parts(spark, d):
    new = pairs2(spark, d).where("q % 5 = 3").select("q", "s", "p", F.lit("c3").alias("country"))
    return tables.reuse(pairs(spark, d).select("q", "s", "p", "country"), new, "country")


@query("SELECT country, count(*) AS n, CAST(sum(('0x' || substr(md5(concat_ws('|', q, s, label)), 1, 7))::BIGINT) AS BIGINT) AS digest FROM pairs GROUP BY country")
def checksum(spark, d):
    return tables.checksum(pairs(spark, d), ["q", "s", "label"], "country")


@query(", u AS (SELECT DISTINCT s AS id FROM pairs2 WHERE p >= 0.95) SELECT 'part' AS tbl, p_partkey AS id FROM part WHERE p_partkey IN (SELECT id FROM u) UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey IN (SELECT id FROM u)")
def bundle(spark, d):
    used = pairs2(spark, d).where("p >= 0.95").select(F.col("s").alias("id")).distinct()
    return tables.bundle({"part": (_t(spark, d, "part"), "p_partkey"), "customer": (_t(spark, d, "customer"), "c_custkey")}, used)


RULES = {"decision": {"c0": {"type": "thr", "t": 0.6}, "c1": {"type": "expf", "floor": 0.3, "alpha": 1.5}, "default": {"type": "expf", "floor": 0.3, "alpha": 1.0}}}


@query("SELECT * FROM (VALUES ('c0', 'thr', 0.6::DOUBLE, 0::DOUBLE, 1::DOUBLE), ('c1', 'expf', 0, 0.3, 1.5), ('default', 'expf', 0, 0.3, 1)) t(country, type, t, floor, alpha)")
def rules_json(spark, d):
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # a driver's file, read back at once
        tables.write_rules(f"{folder}/rules.json", RULES)
        return tables.rule_table(spark, tables.read_rules(f"{folder}/rules.json"))


@query("SELECT vec_id, len(embedding) AS dims, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm2 FROM embeddings")
def src_vectors(spark, d):
    x = F.col("embedding").cast("array<double>")
    return _t(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dims"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v), 4).alias("norm2"))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS code FROM orders")
def country_code(spark, d):
    codes = F.create_map(F.lit("F"), F.lit(0), F.lit("O"), F.lit(1))
    return _t(spark, d, "orders").select("o_orderkey", F.coalesce(codes[F.col("o_orderstatus")], F.lit(-1)).alias("code"))


@query("SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5(concat('7-', o_orderkey)), 1, 7))::BIGINT % 1000 < 100")
def hash_sample(spark, d):
    u = F.conv(F.substring(F.md5(F.concat(F.lit("7-"), F.col("o_orderkey").cast("string"))), 1, 7), 16, 10).cast("long") % 1000
    return _t(spark, d, "orders").where(u < 100).select("o_orderkey")


@query("SELECT s_suppkey, (2 + s_suppkey % 2) * 10000000000 + s_suppkey AS code, concat('S', 2 + s_suppkey % 2, '-', s_suppkey) AS back FROM supplier")
def id_codec(spark, d):
    raw = F.format_string("S%d-%06d", F.lit(2) + F.col("s_suppkey") % 2, F.col("s_suppkey"))
    return _t(spark, d, "supplier").select("s_suppkey", C.id_to_long(raw).alias("code")).withColumn("back", C.long_to_id(F.col("code")))


@query("SELECT c_custkey, concat_ws('|', c_mktsegment, c_nationkey) AS segment, printf('%s/%05d', c_mktsegment, c_custkey) AS label FROM customer")
def segment_key(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("segment"), F.format_string("%s/%05d", "c_mktsegment", "c_custkey").alias("label"))


@query("SELECT q, s, p, country FROM pairs ORDER BY country, p DESC, q, s DESC")
def sort_mixed(spark, d):
    """A range-partitioned sort: no task holds more than its stretch."""
    return pairs(spark, d).select("q", "s", "p", "country").orderBy("country", F.desc("p"), "q", F.desc("s"))


@query("SELECT o_orderkey FROM orders ORDER BY md5(concat('3-', o_orderkey)), o_orderkey LIMIT 100")
def sample_n(spark, d):
    """A sample of a given size (the feature): the smallest hashes, kept map-side."""
    return _t(spark, d, "orders").select("o_orderkey").orderBy(F.md5(F.concat(F.lit("3-"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(100)


@query("SELECT q, s, round(ln(p + 1), 9) AS l, round(exp(-p), 9) AS e, least(greatest(p, 0.2), 0.8) AS clip, abs(p - 0.5) AS a, round(pow(p, 1.5), 9) AS w, q % 7 AS m, q // 7 AS f FROM pairs")
def math_fns(spark, d):
    p = F.col("p")
    return pairs(spark, d).select("q", "s", F.round(F.log(p + 1), 9).alias("l"), F.round(F.exp(-p), 9).alias("e"), F.least(F.greatest(p, F.lit(0.2)), F.lit(0.8)).alias("clip"), F.abs(p - 0.5).alias("a"), F.round(F.pow(p, 1.5), 9).alias("w"), (F.col("q") % 7).alias("m"), F.floor(F.col("q") / 7).alias("f"))


@query("SELECT p_partkey, starts_with(p_name, 'r') AS a, ends_with(p_name, 't') AS b, substr(p_name, 2, 3) AS c, length(p_name) AS d, upper(p_name) AS e, regexp_extract(p_name, '([a-z]+)$', 1) AS f, array_to_string(regexp_extract_all(p_name, '[aeiou]'), '') AS g, contains(p_name, 'ol') AS h FROM part")
def str_fns(spark, d):
    n = F.col("p_name")
    return _t(spark, d, "part").select("p_partkey", n.startswith("r").alias("a"), n.endswith("t").alias("b"), F.substring(n, 2, 3).alias("c"), F.length(n).alias("d"), F.upper(n).alias("e"), F.regexp_extract(n, "([a-z]+)$", 1).alias("f"), F.array_join(F.regexp_extract_all(n, F.lit("[aeiou]"), F.lit(0)), "").alias("g"), n.contains("ol").alias("h"))


@query(""", w AS (SELECT p_partkey, string_split(p_name, ' ') AS x, string_split(lower(p_type), ' ') AS y FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ' ') AS minus, list_contains(x, 'red') AS has, x[1] AS first, x[-1] AS last, x[2] AS second, len(x) AS n,
len(list_filter(x, lambda v: length(v) > 4)) > 0 AS any_long, len(list_filter(x, lambda v: length(v) > 3)) = len(x) AS all_long FROM w""")
def list_fns2(spark, d):
    t = _t(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("x"), F.split(F.lower("p_type"), " ").alias("y"))
    return t.select("p_partkey", C.joined(F.array_sort(F.array_except("x", "y"))).alias("minus"), F.array_contains("x", "red").alias("has"), F.get("x", F.lit(0)).alias("first"), F.element_at("x", -1).alias("last"), F.get("x", F.lit(1)).alias("second"), F.size("x").alias("n"), F.exists("x", lambda v: F.length(v) > 4).alias("any_long"), F.forall("x", lambda v: F.length(v) > 3).alias("all_long"))


@query(", l AS (SELECT s, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS ids FROM (SELECT DISTINCT q, s FROM pairs2) GROUP BY s) SELECT s, CAST(unnest(string_split(ids, ',')) AS BIGINT) AS q FROM l")
def explode_ids(spark, d):
    lists = tables.matching_lists(pairs2(spark, d), pairs2(spark, d).select("s").distinct())
    return tables.explode_ids(lists, "s", "matched").select("s", F.col("id").cast("long").alias("q"))


@query("""SELECT q, s, round(CASE WHEN p <= 0.1 THEN 0.02 WHEN p <= 0.5 THEN 0.02 + (p - 0.1) / 0.4 * 0.28 WHEN p <= 0.9 THEN 0.3 + (p - 0.5) / 0.4 * 0.65 ELSE 0.95 END, 9) AS y FROM pairs""")
def interp(spark, d):
    from ..operators import models

    return pairs(spark, d).select("q", "s", F.round(models.interpolate(F.col("p"), [0.1, 0.5, 0.9], [0.02, 0.3, 0.95]), 9).alias("y"))


# --- names -----------------------------------------------------------------------------------------------------------

_FORMS = ["", " ltd", " private limited", " l l c", " mr", " co inc", " sas"]
_RAW_SQL = ", raw AS (SELECT p_partkey, p_size, p_name, concat(CASE WHEN p_size % 4 = 1 THEN 'the ' ELSE '' END, p_name, " + "CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_FORMS)) + " END) AS name FROM part)\n"


def _raw(spark, d):
    p, k = _t(spark, d, "part"), F.col("p_partkey") % 7
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (k + 1).cast("int"))
    return p.select("p_partkey", "p_size", "p_name", F.concat(F.when(F.col("p_size") % 4 == 1, "the ").otherwise(""), "p_name", form).alias("name"))


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _core_sql(col: str, extra=()) -> str:
    x = f"concat(' ', {col}, ' ')"
    for phrase, word in fixed.SPELLED.items():
        x = f"replace({x}, ' {phrase} ', ' {word} ')"
    bare = f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w <> '' AND w NOT IN ({_in([*fixed.LEGAL, *fixed.TITLES, *extra])})), ' ')"
    return f"CASE WHEN {bare} = '' THEN {col} ELSE {bare} END"


@query(_RAW_SQL + f"SELECT p_partkey, {_core_sql('name')} AS core, replace({_core_sql('name')}, ' ', '') AS run FROM raw")
def name_core(spark, d):
    core = C.name_core(F.col("name"))
    return _raw(spark, d).select("p_partkey", core.alias("core"), F.replace(core, F.lit(" "), F.lit("")).alias("run"))


@query(_RAW_SQL + "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN name ELSE p_name END AS name FROM raw")
def alias(spark, d):
    raw = _raw(spark, d)
    mark = F.element_at(F.array(F.lit(" d/b/a "), F.lit(" aka ")), (F.col("p_size") % 2 + 1).cast("int"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("name")).otherwise(F.concat("name", mark, "p_name"))
    return raw.select("p_partkey", C.drop_alias(text).alias("name"))


@query(_RAW_SQL + "SELECT p_partkey, p_partkey % 5 = 0 AS is_domain, p_partkey % 5 = 1 AS has_alias, p_partkey % 5 = 2 AS nonlatin, p_partkey % 5 = 3 AS missing, CASE WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', '-') ELSE '' END AS domain FROM raw")
def flags(spark, d):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(F.lit("#"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit(".co.in"))).when(k == 1, F.concat("name", F.lit(" t/a me"))).when(k == 2, F.concat("name", F.lit(" 東京都"))).when(k == 3, "  ").otherwise(F.col("name"))
    t = _raw(spark, d).withColumn("text", text)
    x = F.col("text")
    return t.select("p_partkey", C.is_domain(x).alias("is_domain"), C.has_alias(x).alias("has_alias"), C.nonlatin(x).alias("nonlatin"), (F.trim(x) == "").alias("missing"), F.when(C.is_domain(x), C.domain_name(x)).otherwise("").alias("domain"))


@query("SELECT p_partkey, replace(replace(replace(p_name, 'small ring', 'anneau'), 'red', 'rouge'), 'bolt', 'boulon') AS name FROM part")
def script_map(spark, d):
    return _t(spark, d, "part").select("p_partkey", C.replace_phrases(F.col("p_name"), {"red": "rouge", "small ring": "anneau", "bolt": "boulon"}).alias("name"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'small' THEN 'sm' WHEN 'large' THEN 'lg' ELSE w END), ' ') AS name FROM part")
def abbrev(spark, d):
    return _t(spark, d, "part").select("p_partkey", C.map_tokens(F.col("p_name"), {"small": "sm", "large": "lg"}).alias("name"))


@query("SELECT p_partkey, concat(p_size, ' ', p_partkey % 20 + 1, ' street') AS a FROM part WHERE p_partkey % 20 < 20")
def ordinals(spark, d):
    word = F.element_at(F.array(*map(F.lit, fixed.ORDINALS)), (F.col("p_partkey") % 20 + 1).cast("int"))
    text = F.concat_ws(" ", F.concat(F.col("p_size").cast("string"), F.lit("th")), word, F.lit("street"))
    return _t(spark, d, "part").select("p_partkey", C.ordinals(text).alias("a"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'tennessee' WHEN c_nationkey < 10 THEN 'tamil nadu' ELSE 'tn' END AS state FROM customer")
def state_codes(spark, d):
    """The same short form means another state in another country, and nothing in a third."""
    x, n = F.lit("tn"), F.col("c_nationkey")
    return _t(spark, d, "customer").select("c_custkey", F.when(n < 5, C.map_tokens(x, {"tn": "tennessee"})).when(n < 10, C.map_tokens(x, {"tn": "tamil nadu"})).otherwise(x).alias("state"))


@query(_RAW_SQL + f"""SELECT p_partkey, concat('sarl ', p_name, ' and freres') AS name, {_core_sql("concat('sarl ', p_name, ' and freres')", fixed.FRENCH_LEGAL)} AS core, concat(p_size, ' boulevard saint ', p_name) AS addr FROM raw""")
def fr_clean(spark, d):
    name, addr = F.concat(F.lit("s.a.r.l. "), "p_name", F.lit(" et frs")), F.concat(F.col("p_size").cast("string"), F.lit(" bd de st "), "p_name", F.lit(", pays de la loire"))
    return _t(spark, d, "part").select("p_partkey", C.french_name(name).alias("name"), C.french_core(name).alias("core"), C.french_address(addr).alias("addr"))


@query("SELECT p_partkey, p_partkey % 4 = 1 AS veto FROM part")
def legal_veto(spark, d):
    k = F.col("p_partkey") % 4
    a = F.concat("p_name", F.when(k == 3, "").otherwise(" sarl"))
    b = F.concat("p_name", F.when(k == 0, " sarl").when(k == 1, " sas sa").when(k == 2, "").otherwise(" sci"))
    return _t(spark, d, "part").select("p_partkey", C.legal_conflict(a, b).alias("veto"))


@query("SELECT p_partkey, substr(concat(lower(p_name), ' | ', lower(p_type)), 1, 160) AS ce_text, concat(p_name, ' | ', substr(lower(p_type), 1, 80)) AS emb_text FROM part")
def ce_text(spark, d):
    """Input texts of a pair model and of an encoder, with the lengths that these take."""
    return _t(spark, d, "part").select("p_partkey", F.substring(F.concat(F.lower("p_name"), F.lit(" | "), F.lower("p_type")), 1, 160).alias("ce_text"), F.concat("p_name", F.lit(" | "), F.substring(F.lower("p_type"), 1, 80)).alias("emb_text"))


@query("SELECT p_partkey, concat_ws(',', concat(p_size, 'b/', p_partkey), concat('a', p_size, '-c')) AS tokens FROM part")
def alnum(spark, d):
    n = F.col("p_size").cast("string")
    text = F.concat_ws(" ", F.lit("no"), F.concat(n, F.lit("b / ")), F.col("p_partkey").cast("string"), F.concat(F.lit("x/a"), n, F.lit(" - c")), F.lit("end"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(C.alnum_tokens(text), ",").alias("tokens"))


_ADDR = "concat(p_size, ' rue de ', p_name, ', ', p_brand)"


@query(f"SELECT p_partkey, concat(p_size, '|', array_to_string(list_sort(list_distinct(list_concat(['r'], string_split(p_name, ' ')))), ' ')) AS k FROM part")
def addr_key(spark, d):
    addr = F.concat(F.col("p_size").cast("string"), F.lit(" rue de "), "p_name", F.lit(", 75011 paris"))
    return _t(spark, d, "part").select("p_partkey", C.address_key(addr).alias("k"))


# --- change detector -------------------------------------------------------------------------------------------------


def _changed(spark, d):
    """Records that are entities with one change by the part's number."""
    p, k = _t(spark, d, "part"), F.col("p_partkey") % 8
    name, size = F.initcap("p_name"), F.col("p_size").cast("string")
    sn = F.concat(name, F.lit(" Inc"))
    qn = F.when(k == 0, sn).when(k == 1, F.upper(sn)).when(k == 2, F.concat(name, F.lit(" LLC"))).when(k == 3, name).when(k == 4, F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")), F.lit(".com"))).when(k == 5, F.concat(name, F.lit(" Group Inc"))).when(k == 6, F.concat(F.lit("Mr "), sn)).otherwise("")
    sa = F.concat(size, F.lit(" Main Street, Dublin, OH"))
    qa = F.when(k == 1, F.concat(size, F.lit(" Main St, Dublin, Ohio"))).when(k == 2, F.concat((F.col("p_size") + 3).cast("string"), F.lit(" Main Street, Dublin, OH"))).when(k == 3, F.lit("Main Street, Dublin, OH")).when(k == 7, F.lit(None)).otherwise(sa)
    return p.select("p_partkey", qn.alias("qn"), sn.alias("sn"), qa.alias("qa"), sa.alias("sa"))


STATES = {"oh": "ohio", "ny": "new york", "tx": "texas"}


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'n_upper' WHEN 2 THEN 'n_legal_change' WHEN 3 THEN 'n_legal_drop' WHEN 4 THEN 'n_domain' WHEN 5 THEN 'n_add:noise' WHEN 6 THEN 'n_add:title' ELSE 'n_missing' END AS names,
CASE p_partkey % 8 WHEN 1 THEN 'a_chg:street a_state_expand a_street_abbr' WHEN 2 THEN 'a_num_up2_5' WHEN 3 THEN 'a_num_missing' WHEN 7 THEN 'a_missing' ELSE '' END AS addresses FROM part""")
def change_tags(spark, d):
    t = _changed(spark, d)
    names, addresses = changes.tags_udf(changes.name_tags, STATES), changes.tags_udf(changes.address_tags, STATES)
    drop = F.lit("a_num_prefixmatch")  # whether 1 became 14 depends on the number
    return t.select("p_partkey", C.joined(names("qn", "sn")).alias("names"), C.joined(F.array_remove(addresses("qa", "sa"), drop)).alias("addresses"))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '|NSAME' WHEN 1 THEN '|NSAME' WHEN 2 THEN 'LEGAL_CHANGE|UP2_5' WHEN 3 THEN 'LEGAL_DROP|NMISS' WHEN 4 THEN 'DOMAIN|NSAME' WHEN 5 THEN 'ADD|NSAME' WHEN 6 THEN 'TITLE|NSAME' ELSE '|AMISS' END AS signature FROM part")
def ops_sig(spark, d):
    t = _changed(spark, d)
    both = F.concat(changes.tags_udf(changes.name_tags, STATES)("qn", "sn"), changes.tags_udf(changes.address_tags, STATES)("qa", "sa"))
    return t.select("p_partkey", changes.signature_udf(both).alias("signature"))


@query("SELECT p_partkey, p_partkey % 8 IN (0, 1, 3, 4) AS ok FROM part")
def name_judge(spark, d):
    return _changed(spark, d).select("p_partkey", changes.noise_udf("qn", "sn").alias("ok"))
