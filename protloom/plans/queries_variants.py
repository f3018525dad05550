"""Queries on variants, genotypes and cohorts."""

from pyspark.sql import functions as F

from ..functions import genotype as g
from ..functions.sequence import falsey
from ..operators import annotate, cohort, intervals, matrix, transcripts, variants
from ..sources import faults, store, text
from .bindings import aa_of, rc
from .catalog import query

CHROM = "regexp_replace(chrom, '^chr', '') IN ('1','2','3','4','5','6','7','8','9','10','11','12','13','14','15','16','17','18','19','20','21','22','X','Y','M')"


def vcf(t):
    return text.parse_vcf(t.v_vcf_line, ["s1", "s2"])


@query("vcf_scan", "SELECT chrom, pos, id, ref, alt, filter, info, s1, s2 FROM {v_vcf}")
def _(t):
    return vcf(t).select("chrom", "pos", "id", "ref", "alt", "filter", "info", "s1", "s2")


BAD_LINES = """SELECT rid, CASE l_linenumber WHEN 2 THEN 'chr1' || chr(9) || '7' WHEN 3 THEN replace(value, chr(9) || CAST(l_partkey AS string) || chr(9), chr(9) || 'x' || CAST(l_partkey AS string) || chr(9)) WHEN 4 THEN replace(value, chr(9) || 'PASS', '') WHEN 5 THEN '#' || value WHEN 6 THEN value || chr(9) || '0|1' ELSE value END AS value FROM (SELECT *, 'chr1' || chr(9) || CAST(l_partkey AS string) || chr(9) || rid || chr(9) || CASE WHEN l_suppkey % 5 = 0 THEN '<DEL>' ELSE 'A' END || chr(9) || CASE WHEN l_suppkey % 7 = 0 THEN '.' ELSE 'C' END || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || '.' || chr(9) || 'GT' || chr(9) || '0|1' AS value FROM {v_line})"""


HEADERS = "SELECT '#CHROM' || chr(9) || 'POS' || chr(9) || 'ID' || chr(9) || 'REF' || chr(9) || 'ALT' || chr(9) || 'QUAL' || chr(9) || 'FILTER' || chr(9) || 'INFO' || chr(9) || 'FORMAT' || chr(9) || 's' || CAST(c_nationkey AS string) || chr(9) || 't' || CAST(c_nationkey % 3 AS string) AS value FROM {customer} UNION ALL SELECT '##' || c_name AS value FROM {customer}"


@query("header_samples", f"""WITH l AS ({HEADERS}), h AS (SELECT DISTINCT value FROM l WHERE value LIKE '#CHROM%'), r AS (SELECT CAST(row_number() OVER (ORDER BY value) AS int) AS header, string_split(value, chr(9))[10:] AS names FROM h)
SELECT header, CAST(unnest(range(len(names))) AS int) AS i, unnest(names) AS sample FROM r""")
def _(t):
    return text.header_samples(t.sql(HEADERS))


CARRIED = "SELECT CAST(l_suppkey % 25 AS string) AS chr, l_partkey AS pos, 'A' AS ref, substr('CGT', CAST(l_linenumber % 3 + 1 AS int), 1) AS alt, 's' || CAST(o_custkey % 4 AS string) || '__' || CAST(l_linenumber % 2 + 1 AS string) AS sample FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
SAMPLES = [f"s{s}__{h}" for s in range(4) for h in (1, 2)]


@query("cohort_table", f"WITH c AS ({CARRIED}) SELECT chr, pos, ref, alt, " + ", ".join(f"CAST(coalesce(bool_or(sample = '{s}'), false) AS int) AS {s}" for s in SAMPLES) + " FROM c GROUP BY chr, pos, ref, alt")
def _(t):
    return cohort.wide(t.sql(CARRIED), ["chr", "pos", "ref", "alt"], SAMPLES)


@query("vcf_faults", f"""WITH b AS ({BAD_LINES}), f AS (SELECT value, string_split(value, chr(9)) AS f FROM b WHERE value NOT LIKE '#%'),
r AS (SELECT CASE WHEN len(f) < 8 THEN 'few columns' WHEN coalesce(TRY_CAST(f[2] AS bigint), 0) <= 0 THEN 'bad position' WHEN NOT regexp_full_match(f[4], '[A-Za-z]+') THEN 'bad reference' WHEN trim(f[5]) IN ('', '.') THEN 'no alternative' WHEN len(f) < 10 THEN 'missing calls' END AS reason FROM f)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def _(t):
    return faults.by_reason(faults.vcf_faults(t.sql(BAD_LINES).select("value"), 1))


@query("vcf_filter_pass", "SELECT id, chrom, pos FROM {v_vcf} WHERE filter = 'PASS'")
def _(t):
    return variants.filter_records(vcf(t), chromosomes=False).select("id", "chrom", "pos")


@query("vcf_filter_chrom", f"SELECT id, chrom, pos FROM {{v_vcf}} WHERE {CHROM}")
def _(t):
    return variants.filter_records(vcf(t), only_pass=False).select("id", "chrom", "pos")


@query("info_threshold", """SELECT rid, info FROM {v_info} WHERE NOT regexp_matches(info, '(^|;)AF=') OR list_bool_or(list_transform(string_split(regexp_extract(info, '(^|;)AF=([^;]*)', 2), ','), lambda x: TRY_CAST(x AS double) >= 0.05))""")
def _(t):
    return t.v_info.where(g.info_passes(F.col("info"), "AF", 0.05)).select("rid", "info")


@query("gt_homref_skip", "SELECT id, s1, s2 FROM {v_vcf} WHERE NOT (split_part(s1, ':', 1) IN ('0|0', '0/0', './.', '.|.') AND split_part(s2, ':', 1) IN ('0|0', '0/0', './.', '.|.'))")
def _(t):
    return vcf(t).where(~F.forall(F.array("s1", "s2"), g.homozygous_reference_or_missing)).select("id", "s1", "s2")


@query("gt_missing_skip", "SELECT id, s1, s2 FROM {v_vcf} WHERE NOT (split_part(s1, ':', 1) LIKE '%.%' AND split_part(s2, ':', 1) LIKE '%.%')")
def _(t):
    return vcf(t).where(~F.forall(F.array("s1", "s2"), g.missing)).select("id", "s1", "s2")


A1 = "coalesce(TRY_CAST(split_part(replace(split_part({c}, ':', 1), '/', '|'), '|', 1) AS int), 0)"
A2 = A1.replace(", 1) AS int)", ", 2) AS int)")


@query("gt_parse", f"SELECT rid, {A1.format(c='gt')} AS a1, {A2.format(c='gt')} AS a2 FROM {{v_gt}}")
def _(t):
    return t.v_gt.select("rid", g.alleles(F.col("gt"))[0].alias("a1"), g.alleles(F.col("gt"))[1].alias("a2"))


def _haplotype_sql(keep: str = "hap, chr, pos, ref, alt") -> str:
    return f"""WITH rows_ AS (SELECT *, {A1.format(c='s1')} AS a1, {A2.format(c='s1')} AS a2 FROM {{v_vcf}} WHERE filter = 'PASS' AND {CHROM} AND split_part(s1, ':', 1) NOT IN ('0|0', '0/0', '.')),
both_ AS (SELECT 1 AS hap, a1 AS n, * FROM rows_ UNION ALL SELECT 2 AS hap, a2 AS n, * FROM rows_),
text_ AS (SELECT hap, chrom AS chr, pos, ref, CASE WHEN n = 0 THEN ref ELSE nullif(split_part(alt, ',', n), '') END AS alt, id FROM both_),
first_ AS (SELECT *, row_number() OVER (PARTITION BY hap, chr, pos, ref ORDER BY id, alt) AS rn FROM text_ WHERE alt IS NOT NULL AND alt <> ref AND alt <> '*')
SELECT {keep} FROM first_ WHERE rn = 1"""


def haplotypes(t):
    return variants.haplotypes(vcf(t), "s1", ["id", "alt"])


@query("haplotype_split", _haplotype_sql())
def _(t):
    return haplotypes(t)


@query("union_haplotypes", _haplotype_sql("DISTINCT chr, pos, ref, alt"))
def _(t):
    h = haplotypes(t)
    cols = ["chr", "pos", "ref", "alt"]
    return h.where("hap = 1").select(*cols).unionByName(h.where("hap = 2").select(*cols)).distinct()


@query("changed_both_haplotypes", _haplotype_sql("chr, pos, ref, alt, hap").replace("SELECT chr, pos, ref, alt, hap", "SELECT chr, pos, ref, alt") + " GROUP BY chr, pos, ref, alt HAVING count(DISTINCT hap) = 2")
def _(t):
    h = haplotypes(t)
    cols = ["chr", "pos", "ref", "alt"]
    return h.where("hap = 1").select(*cols).intersect(h.where("hap = 2").select(*cols))


@query("haplotype_merge", _haplotype_sql("chr, pos, ref, alt, string_agg(CAST(hap AS varchar), '' ORDER BY hap) AS label") + " GROUP BY chr, pos, ref, alt")
def _(t):
    return variants.merge_haplotypes(haplotypes(t), ["chr", "pos", "ref", "alt"])


@query("dedupe_keep_first", "SELECT chrom, pos, ref, id, alt FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref ORDER BY id, alt) AS rn FROM {v_vcf}) WHERE rn = 1")
def _(t):
    return variants.keep_first(vcf(t), ["chrom", "pos", "ref"], ["id", "alt"]).select("chrom", "pos", "ref", "id", "alt")


def _hap(s: str, a: str) -> str:
    return f"CAST({a.format(c=s)} = i AS int)"


EXPLODED = f"""SELECT id, chrom, pos, ref, x AS alt, {_hap('s1', A1)} AS s1__1, {_hap('s1', A2)} AS s1__2, {_hap('s2', A1)} AS s2__1, {_hap('s2', A2)} AS s2__2
FROM (SELECT *, unnest(string_split(alt, ',')) AS x, unnest(range(1, len(string_split(alt, ',')) + 1)) AS i FROM {{v_vcf}}
WHERE NOT (split_part(s1, ':', 1) IN ('0|0', '0/0', './.', '.|.') AND split_part(s2, ':', 1) IN ('0|0', '0/0', './.', '.|.')) AND NOT (split_part(s1, ':', 1) LIKE '%.%' AND split_part(s2, ':', 1) LIKE '%.%')) WHERE x <> ref AND x <> '*'"""


def exploded(t):
    return variants.explode_alternatives(vcf(t).select("id", "chrom", "pos", "ref", "alt", "s1", "s2"), ["s1", "s2"])


@query("multiallelic_explode", EXPLODED)
def _(t):
    return exploded(t)


@query("carriers_long", f"""WITH m AS ({EXPLODED}), u AS (SELECT id, pos, alt, 's1' AS sample, 1 AS hap, s1__1 AS v FROM m UNION ALL SELECT id, pos, alt, 's1', 2, s1__2 FROM m UNION ALL SELECT id, pos, alt, 's2', 1, s2__1 FROM m UNION ALL SELECT id, pos, alt, 's2', 2, s2__2 FROM m)
SELECT id, pos, alt, sample, hap FROM u WHERE v = 1""")
def _(t):
    return variants.carriers(exploded(t), ["id", "pos", "alt"], ["s1__1", "s1__2", "s2__1", "s2__2"])


@query("matrix_carriers", f"""WITH m AS ({EXPLODED}), u AS (SELECT id, chrom, pos, ref, alt, 0 AS i, 1 AS hap, s1__1 AS v FROM m UNION ALL SELECT id, chrom, pos, ref, alt, 0, 2, s1__2 FROM m UNION ALL SELECT id, chrom, pos, ref, alt, 1, 1, s2__1 FROM m UNION ALL SELECT id, chrom, pos, ref, alt, 1, 2, s2__2 FROM m)
SELECT id, chrom, pos, ref, alt, i, hap FROM u WHERE v = 1""")
def _(t):
    ids = ["id", "chrom", "pos"]
    return matrix.carriers(matrix.pack(text.with_cells(t.v_vcf_line), ids, 2), ids)


@query("manifest_pivot", f"""WITH m AS ({EXPLODED}), u AS (SELECT chrom, pos, ref, alt, 's1' AS sample, s1__1 + s1__2 AS v FROM m UNION ALL SELECT chrom, pos, ref, alt, 's2', s2__1 + s2__2 FROM m)
SELECT chrom, pos, ref, alt, max(v) FILTER (sample = 's1') AS s1, max(v) FILTER (sample = 's2') AS s2 FROM u GROUP BY ALL""")
def _(t):
    u = exploded(t).selectExpr("chrom", "pos", "ref", "alt", "stack(2, 's1', s1__1 + s1__2, 's2', s2__1 + s2__2) AS (sample, v)")
    return u.groupBy("chrom", "pos", "ref", "alt").pivot("sample", ["s1", "s2"]).agg(F.max("v"))


@query("manifest_allele_or", f"""WITH m AS ({EXPLODED}) SELECT chrom, pos, ref, alt, 'f' || CAST(pos % 3 AS varchar) AS sample, max(s1__1) AS hap1, max(s1__2) AS hap2 FROM m GROUP BY ALL""")
def _(t):
    rows = exploded(t).select("chrom", "pos", "ref", "alt", F.concat(F.lit("f"), (F.col("pos") % 3).cast("string")).alias("sample"), F.col("s1__1").alias("hap1"), F.col("s1__2").alias("hap2"))
    return variants.manifest_merge(rows, ["chrom", "pos", "ref", "alt"]).orderBy("chrom", "pos", "ref", "alt")


@query("manifest_names", """WITH f AS (SELECT '/data/' || n_name || '_' || CAST(n_nationkey AS varchar) || CASE WHEN n_nationkey % 2 = 0 THEN '.vcf.gz' ELSE '.VCF' END AS filepath, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'r' || CAST(n_regionkey AS varchar) || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END END AS sample FROM {nation}),
s AS (SELECT filepath, regexp_replace(split_part(filepath, '/', 3), '(?i)\\.vcf(\\.gz|\\.bgz)?$', '') AS stem, sample FROM f), n AS (SELECT *, coalesce(nullif(trim(sample), ''), stem) AS name FROM s)
SELECT filepath, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN stem ELSE name END AS name FROM n""")
def _(t):
    rows = t.sql("SELECT '/data/' || n_name || '_' || CAST(n_nationkey AS string) || CASE WHEN n_nationkey % 2 = 0 THEN '.vcf.gz' ELSE '.VCF' END AS filepath, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'r' || CAST(n_regionkey AS string) || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END END AS sample FROM {nation}")
    return variants.sample_names(rows)


@query("tsv_variants", "SELECT CAST(l_suppkey AS varchar) AS chr, l_partkey AS pos, upper(substr('acgt', l_linenumber % 4 + 1, 2)) AS ref, substr('ACGT', l_linenumber % 3 + 1, 1) AS alt, rid, l_partkey + length(substr('acgt', l_linenumber % 4 + 1, 2)) - 1 AS pos_end FROM {v_line}")
def _(t):
    rows = t.sql("SELECT rid, substr('ACGT', l_linenumber % 3 + 1, 1) AS Alt, l_suppkey AS CHR, substr('acgt', l_linenumber % 4 + 1, 2) AS ref, l_partkey AS pos FROM {v_line}")
    return text.variants_tsv(rows)


@query("variant_string_parse", """WITH s AS (SELECT rid, unnest(string_split('chr' || CAST(l_suppkey AS varchar) || '-' || CAST(l_partkey AS varchar) || '-a-T,X-5-A-C, ' || CAST(l_linenumber AS varchar) || '-' || CAST(l_orderkey AS varchar) || '-AC-g', ',')) AS v FROM {v_line})
SELECT rid, regexp_extract(trim(v), '^(chr)?(\\d+)-(\\d+)-([A-Za-z]+)-([A-Za-z]+)$', 2) AS chr, CAST(regexp_extract(trim(v), '^(chr)?(\\d+)-(\\d+)-([A-Za-z]+)-([A-Za-z]+)$', 3) AS bigint) AS pos, upper(regexp_extract(trim(v), '^(chr)?(\\d+)-(\\d+)-([A-Za-z]+)-([A-Za-z]+)$', 4)) AS ref, upper(regexp_extract(trim(v), '^(chr)?(\\d+)-(\\d+)-([A-Za-z]+)-([A-Za-z]+)$', 5)) AS alt FROM s WHERE regexp_matches(trim(v), '^(chr)?\\d+-\\d+-[A-Za-z]+-[A-Za-z]+$')""")
def _(t):
    rows = t.sql("SELECT rid, 'chr' || CAST(l_suppkey AS string) || '-' || CAST(l_partkey AS string) || '-a-T,X-5-A-C, ' || CAST(l_linenumber AS string) || '-' || CAST(l_orderkey AS string) || '-AC-g' AS v FROM {v_line}")
    return text.literal_variants(rows, "v")


@query("sample_truthiness", "SELECT event_id, cell FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '.' WHEN 3 THEN NULL WHEN 4 THEN 'N/A' WHEN 5 THEN ' ' WHEN 6 THEN event_type WHEN 7 THEN '[]' ELSE '0.0' END AS cell FROM {events}) WHERE event_id % 9 IN (1, 6)")
def _(t):
    rows = t.sql("SELECT event_id, CASE event_id % 9 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '.' WHEN 3 THEN NULL WHEN 4 THEN 'N/A' WHEN 5 THEN ' ' WHEN 6 THEN event_type WHEN 7 THEN '[]' ELSE '0.0' END AS cell FROM {events}")
    return rows.where(~falsey(F.col("cell")))


@query("variants_sorted", "SELECT rid, l_suppkey AS chr, l_partkey AS pos FROM {v_line} ORDER BY chr, pos, rid")
def _(t):
    return t.v_line.select("rid", F.col("l_suppkey").alias("chr"), F.col("l_partkey").alias("pos")).orderBy("chr", "pos", "rid")


@query("variants_by_chrom", "SELECT chr, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM {v_variant} GROUP BY chr")
def _(t):
    return t.v_variant.groupBy("chr").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


INTERVAL = 'FROM {v_variant} v JOIN {v_block} b ON v.chr = b.chr AND v.pos {op} b.start AND v.pos_end <= b."end"'


@query("interval_join", "SELECT v.chr, v.variant_id, v.pos, v.pos_end, b.protein_id " + INTERVAL.replace("{op}", ">="))
def _(t):
    return intervals.interval_join(t.v_variant, t.v_block).select("chr", "variant_id", "pos", "pos_end", "protein_id")


@query("interval_join_store", "SELECT v.chr, v.variant_id, b.protein_id " + INTERVAL.replace("{op}", ">"))
def _(t):
    return intervals.interval_join(t.v_variant, t.v_block, open_start=True).select("chr", "variant_id", "protein_id")


@query("interval_join_binned", "SELECT b.protein_id, count(*) AS n_variants, min(v.pos) AS first_pos, max(v.pos_end) AS last_pos " + INTERVAL.replace("{op}", ">=") + " GROUP BY b.protein_id")
def _(t):
    hits = intervals.interval_join(t.v_variant, t.v_block, bin_width=64)
    return hits.groupBy("protein_id").agg(F.count("*").alias("n_variants"), F.min("pos").alias("first_pos"), F.max("pos_end").alias("last_pos"))


@query("variants_per_protein", "SELECT protein_id, count(*) AS n_variants, string_agg(variant_id, ',' ORDER BY variant_id) AS variants FROM (SELECT DISTINCT b.protein_id, v.variant_id " + INTERVAL.replace("{op}", ">=") + ") GROUP BY protein_id")
def _(t):
    return intervals.variants_per_protein(intervals.interval_join(t.v_variant, t.v_block))


@query("split_complex", """WITH m AS (SELECT *, least(length(ref), length(alt)) AS n FROM {v_mnv}),
e AS (SELECT rid, pos, ref, alt, n, unnest(range(1, n + 1)) AS i FROM m WHERE length(ref) > 1 AND length(alt) > 1)
SELECT rid, pos + i - 1 AS pos, CASE WHEN i = n THEN substr(ref, i) ELSE substr(ref, i, 1) END AS ref, CASE WHEN i = n THEN substr(alt, i) ELSE substr(alt, i, 1) END AS alt FROM e WHERE i = n OR substr(ref, i, 1) <> substr(alt, i, 1)
UNION ALL SELECT rid, pos, ref, alt FROM m WHERE NOT (length(ref) > 1 AND length(alt) > 1)""")
def _(t):
    return variants.split_complex(t.v_mnv)


EDITS = f"""SELECT doc_id, 'd' || CAST(doc_id AS varchar) AS chr, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, pos, ref, alt FROM {{v_edit}}"""
EDIT_RECORDS = f"""WITH v AS ({EDITS}), e AS (SELECT doc_id, strand, chr || '-' || CAST(pos AS varchar) || '-' || ref || '-' || alt AS variant_id, pos, ref, alt FROM v WHERE length(ref) = 1
UNION ALL SELECT doc_id, strand, chr || '-' || CAST(pos AS varchar) || '-' || ref || '-' || alt, pos + i, substr(ref, i + 1, 1), '' FROM (SELECT *, unnest(range(1, length(ref))) AS i FROM v WHERE length(ref) > 1)),
er AS (SELECT doc_id, variant_id, pos, CASE WHEN strand = '-' THEN {rc('ref')} ELSE ref END AS ref, CASE WHEN strand = '-' THEN {rc('alt')} ELSE alt END AS alt FROM e)
"""


def edits(t):
    rows = t.v_edit.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chr"), "pos", "ref", "alt")
    return variants.edit_records(rows, F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-")).drop("chr")


@query("edit_records", EDIT_RECORDS + "SELECT doc_id, variant_id, pos, ref, alt FROM er")
def _(t):
    return edits(t)


PATTERNS = "WITH s AS (SELECT protein_id, sample, string_agg(variant_id, ',' ORDER BY variant_id) AS pattern FROM (SELECT DISTINCT * FROM {v_carrier}) GROUP BY protein_id, sample), p AS (SELECT protein_id, pattern, count(*) AS n_samples, string_agg(CAST(sample AS varchar), ',' ORDER BY CAST(sample AS varchar)) AS samples FROM s GROUP BY protein_id, pattern)\n"


@query("sample_pattern_group", PATTERNS + "SELECT * FROM p")
def _(t):
    return cohort.sample_patterns(t.v_carrier)


@query("variant_form_number", PATTERNS + "SELECT protein_id, pattern, n_samples, samples, CAST(row_number() OVER (PARTITION BY protein_id ORDER BY pattern) AS int) AS form, CAST(protein_id AS varchar) || '__' || CAST(row_number() OVER (PARTITION BY protein_id ORDER BY pattern) AS varchar) AS form_id FROM p")
def _(t):
    return cohort.numbered_forms(cohort.sample_patterns(t.v_carrier), "protein_id", ["pattern"])


@query("individual_collapse", "SELECT c_nationkey, c_mktsegment, string_agg(k, ',' ORDER BY k) AS individuals FROM (SELECT DISTINCT c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment, CAST(c_custkey AS varchar) AS k FROM {customer}) GROUP BY c_nationkey, c_mktsegment")
def _(t):
    rows = t.customer.withColumn("c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return cohort.collapse_individuals(rows, ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("protein_all_cohort", "SELECT doc_id, lang FROM {v_protein} WHERE doc_id NOT IN (SELECT protein_id FROM {v_carrier} GROUP BY protein_id HAVING count(DISTINCT sample) >= 8)")
def _(t):
    return cohort.still_unchanged(t.v_protein.select("doc_id", "lang"), t.v_carrier.withColumnRenamed("protein_id", "doc_id"), 8, "doc_id")


@query("change_counts", PATTERNS + "SELECT count(*) AS n_forms, count(DISTINCT protein_id) AS n_proteins, CAST(sum(n_samples) AS bigint) AS n_samples FROM p")
def _(t):
    p = cohort.sample_patterns(t.v_carrier)
    return p.agg(F.count("*").alias("n_forms"), F.count_distinct("protein_id").alias("n_proteins"), F.sum("n_samples").alias("n_samples"))


@query("upsert_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value FROM {events} GROUP BY user_id")
def _(t):
    return store.latest(t.events.select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("store_point_lookup", 'SELECT protein_id, chr, start, "end" FROM {v_block} WHERE protein_id = 42')
def _(t):
    return t.v_block.where("protein_id = 42").select("protein_id", "chr", "start", "end")


@query("store_inlist_lookup", 'SELECT protein_id, chr, start, "end" FROM {v_block} WHERE protein_id IN (SELECT protein_id FROM {v_carrier})')
def _(t):
    return store.of_proteins(t.v_block, t.v_carrier).select("protein_id", "chr", "start", "end")


@query("ffill", "SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM {events})".replace("last_value(v IGNORE NULLS)", "last_value(v IGNORE NULLS)"))
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", "user_id", F.last(F.when(F.col("event_id") % 3 == 0, F.col("value")), ignorenulls=True).over(w).alias("filled"))


OFFSETS = '(SELECT *, CAST(coalesce(sum("end" - start + 1) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS before, CAST(sum("end" - start + 1) OVER (PARTITION BY doc_id) AS bigint) AS total FROM {v_tx})'
CDS = f"""(SELECT doc_id, strand, CASE WHEN strand = '-' THEN {rc('f')} ELSE f END AS cds FROM (SELECT t.doc_id, t.strand, string_agg(substr(q, CAST(start AS bigint), CAST("end" - start + 1 AS bigint)), '' ORDER BY start) AS f FROM {{v_tx}} t JOIN {{v_dna}} d ON t.doc_id = d.doc_id GROUP BY t.doc_id, t.strand))"""


def coding(t):
    """(doc_id, strand, cds), oriented."""
    return transcripts.coding_sequence(t.v_tx, t.v_dna.select("doc_id", "q"), ["doc_id"], "doc_id", "q", oriented=True)


def located(t, rows):
    """Variants or edits of documents with their offset in the coding sequence; rows(doc_id, pos, ...)."""
    placed = transcripts.cds_offsets(t.v_tx, ["doc_id"])
    hits = intervals.interval_join(rows.withColumn("pos_end", F.col("pos")), placed, bin_width=64, keys=("doc_id",))
    return hits.withColumn("offset", transcripts.coding_offset(F.col("pos"), F.col("start"), F.col("before"), F.col("total"), F.col("strand")))


SNV = f"""WITH o AS {OFFSETS}, c AS {CDS}, h AS (SELECT s.doc_id, s.pos, s.ref, s.alt, o.strand, CASE WHEN o.strand = '-' THEN total - 1 - (s.pos - start + before) ELSE s.pos - start + before END AS off FROM {{v_snv}} s JOIN o ON s.doc_id = o.doc_id AND s.pos BETWEEN start AND "end"),
k AS (SELECT h.doc_id, pos, ref, alt, h.strand, off, substr(cds, off // 3 * 3 + 1, 3) AS codon, off % 3 AS place FROM h JOIN c ON h.doc_id = c.doc_id),
e AS (SELECT doc_id, pos, off // 3 + 1 AS aa_index, codon, substr(codon, 1, place) || CASE WHEN strand = '-' THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END || substr(codon, place + 2) AS edited, ref, alt FROM k)
SELECT doc_id, CAST(doc_id AS varchar) || '-' || CAST(pos AS varchar) || '-' || ref || '-' || alt AS variant_id, aa_index, {aa_of('codon')} AS ref_aa, {aa_of('edited')} AS alt_aa FROM e WHERE {aa_of('codon')} <> {aa_of('edited')}"""


@query("snv_effect", SNV)
def _(t):
    hits = located(t, t.v_snv.withColumn("variant_id", variants.variant_id(F.col("doc_id"), F.col("pos"), F.col("ref"), F.col("alt"))))
    return annotate.snv_effects(hits.select("doc_id", "variant_id", "offset", "strand", "ref", "alt"), coding(t).select("doc_id", "cds"), ["doc_id"])
