"""Queries on gene models, contigs, coding sequences and effects on proteins."""

from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import annotate, intervals, transcripts
from ..operators.edited import with_protein
from ..sources import text
from .bindings import aa_of, aa_text, rc
from .catalog import query
from .queries_variants import CDS, EDIT_RECORDS, OFFSETS, coding, edits, located


@query("gtf_scan", 'SELECT seqname, feature, start, "end", strand, frame FROM {v_gtf} WHERE feature IN (\'CDS\', \'exon\')')
def _(t):
    return text.parse_gtf(t.v_gtf_line).where(F.col("feature").isin("CDS", "exon")).select("seqname", "feature", "start", "end", "strand", "frame")


@query("gtf_attr_map", """SELECT seqname, start, regexp_extract(attributes, 'gene_id "(H[^"]*)"', 1) AS gene_id, regexp_extract(attributes, 'transcript_id "([^"]*)"', 1) AS transcript_id, nullif(regexp_extract(attributes, 'protein_id "([^"]*)"', 1), '') AS protein_id FROM {v_gtf}""")
def _(t):
    m = text.attributes(F.col("attributes"))
    return text.parse_gtf(t.v_gtf_line).select("seqname", "start", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("gene_id", "transcript_id", "protein_id")])


@query("gtf_semi", """SELECT g.seqname, g.start, g.feature FROM {v_gtf} g WHERE EXISTS (SELECT 1 FROM {v_block} b WHERE b.protein_id % 500 % 3 = 0 AND 'chr' || CAST(b.chr AS varchar) = g.seqname AND 'P' || CAST(b.protein_id % 500 AS varchar) = regexp_extract(g.attributes, 'protein_id "([^"]*)"', 1))""")
def _(t):
    g = text.parse_gtf(t.v_gtf_line).withColumn("protein", F.try_element_at(text.attributes(F.col("attributes")), F.lit("protein_id")))
    placed = t.sql("SELECT 'chr' || CAST(chr AS string) AS seqname, 'P' || CAST(protein_id % 500 AS string) AS protein FROM {v_block} WHERE protein_id % 500 % 3 = 0")
    return transcripts.models_of(g, placed, ["seqname", "protein"]).select("seqname", "start", "feature")


@query("refseq_tx2prot", """WITH a AS (SELECT seqname, start, feature, regexp_extract(attributes, 'transcript_id "([^"]*)"', 1) AS transcript_id, nullif(regexp_extract(attributes, 'protein_id "([^"]*)"', 1), '') AS protein_id FROM {v_gtf}),
m AS (SELECT transcript_id, min(protein_id) AS p FROM a WHERE protein_id IS NOT NULL GROUP BY transcript_id) SELECT seqname, start, feature, a.transcript_id, coalesce(protein_id, p) AS protein_id FROM a LEFT JOIN m ON a.transcript_id = m.transcript_id""")
def _(t):
    m = text.attributes(F.col("attributes"))
    g = text.parse_gtf(t.v_gtf_line).select("seqname", "start", "feature", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("transcript_id", "protein_id")])
    return transcripts.exon_proteins(g).select("seqname", "start", "feature", "transcript_id", "protein_id")


@query("protein_first_chrom", "SELECT tx, arg_min(chrom, line_no) AS chrom, count(DISTINCT chrom) AS n_chrom FROM {v_model} GROUP BY tx")
def _(t):
    return transcripts.first_chromosome(t.v_model, "tx", "chrom", "line_no")


@query("protein_not_in_genome", "SELECT doc_id, lang FROM {v_protein} WHERE doc_id NOT IN (SELECT tx FROM {v_model})")
def _(t):
    return transcripts.not_in_genome(t.v_protein.select("doc_id", "lang"), t.v_model.select(F.col("tx").alias("doc_id")), "doc_id")


ID = "CASE doc_id % 3 WHEN 0 THEN 'ENST' || CAST(doc_id AS {s}) || '.1|ENSP' || CAST(doc_id AS {s}) || '.2|x' WHEN 1 THEN 'ENSP' || CAST(doc_id AS {s}) || '.7' ELSE 'NP_' || CAST(doc_id AS {s}) || '.7' END AS header, CASE doc_id % 3 WHEN 0 THEN 'GENCODE_GTF' WHEN 1 THEN 'Ensembl_GTF' ELSE 'RefSeq' END AS datatype"


@query("protein_id_derive", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN split_part(header, '|', 2) WHEN 1 THEN split_part(header, '.', 1) ELSE header END AS protein_id FROM (SELECT doc_id, {ID.format(s='varchar')} FROM {{documents}})")
def _(t):
    rows = t.sql(f"SELECT doc_id, {ID.format(s='string')} FROM {{documents}}")
    return rows.select("doc_id", transcripts.protein_id(F.col("header"), F.col("datatype")).alias("protein_id"))


CONTIGS = "SELECT CASE c_custkey % 4 WHEN 0 THEN 'chr' || CAST(c_custkey AS {s}) WHEN 1 THEN CAST(c_custkey AS {s}) ELSE 'NC_' || CAST(c_custkey AS {s}) END AS id, CASE WHEN c_custkey = 7 THEN 'Homo sapiens mitochondrion, complete' ELSE 'Homo sapiens chromosome ' || CAST(c_custkey AS {s}) || ', primary' END AS description FROM {{customer}}"


@query("contig_resolve", f"""WITH c AS ({CONTIGS.format(s='varchar')}), n AS (SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 'chr' ELSE '' END || CASE WHEN l_partkey % 50 = 0 THEN 'M' ELSE CAST(l_partkey AS varchar) END AS name FROM {{lineitem}}), k AS (SELECT name, regexp_replace(name, '^chr', '') AS k FROM n)
SELECT name, coalesce(a.id, b.id, CASE WHEN k = 'M' THEN (SELECT min(id) FROM c WHERE lower(description) LIKE '%mitochondrion%') END, d.id, k) AS contig FROM k LEFT JOIN c a ON k = a.id LEFT JOIN c b ON 'chr' || k = b.id LEFT JOIN c d ON regexp_extract(d.description, 'chromosome ([^ ,]+),', 1) = k""")
def _(t):
    names = t.sql("SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 'chr' ELSE '' END || CASE WHEN l_partkey % 50 = 0 THEN 'M' ELSE CAST(l_partkey AS string) END AS name FROM {lineitem}")
    return transcripts.resolve_contigs(names, t.sql(CONTIGS.format(s="string")))


@query("cds_blocks", """SELECT tx, chrom, string_agg(CAST(start AS varchar) || '-' || CAST("end" AS varchar), ',' ORDER BY start, "end") AS blocks, min(start) AS cds_start, max("end") AS cds_end, CAST(sum("end" - start + 1) AS bigint) AS cds_len FROM {v_model} WHERE feature = 'CDS' GROUP BY tx, chrom""")
def _(t):
    b = transcripts.cds_blocks(t.v_model.where("feature = 'CDS'"), ["tx", "chrom"])
    return b.withColumn("blocks", F.array_join(F.transform("blocks", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ","))


@query("blocks_explode", """SELECT tx, chrom, start - 1 AS start0, "end", CAST(row_number() OVER (PARTITION BY tx, chrom ORDER BY start, "end") AS int) AS block_no FROM {v_model} WHERE feature = 'CDS'""")
def _(t):
    b = transcripts.cds_blocks(t.v_model.where("feature = 'CDS'"), ["tx", "chrom"])
    return b.select("tx", "chrom", F.posexplode("blocks").alias("i", "b")).select("tx", "chrom", (F.col("b.start") - 1).alias("start0"), "b.end", (F.col("i") + 1).alias("block_no"))


@query("cdsplus", """WITH f AS (SELECT tx, CASE WHEN strand = '+' THEN arg_min(start, (start, "end")) ELSE arg_max(start, start) END AS fs, CASE WHEN strand = '+' THEN arg_min("end", (start, "end")) ELSE arg_max("end", start) END AS fe, CASE WHEN strand = '+' THEN arg_min(frame, (start, "end")) ELSE arg_max(frame, start) END AS frame FROM {v_model} WHERE feature = 'CDS' GROUP BY tx, strand),
x AS (SELECT tx, bool_or(feature = 'exon') AS has FROM {v_model} GROUP BY tx)
SELECT DISTINCT m.tx, f.frame, m.start, m."end" FROM {v_model} m JOIN f ON m.tx = f.tx JOIN x ON m.tx = x.tx
WHERE CASE WHEN NOT has THEN feature = 'CDS' ELSE (feature = 'CDS' AND start = fs AND "end" = fe) OR (feature = 'exon' AND CASE WHEN strand = '+' THEN start >= fe ELSE "end" <= fs END) END""")
def _(t):
    return transcripts.cds_plus(t.v_model, ["tx"])


@query("cds_offset", f"WITH o AS {OFFSETS} SELECT doc_id, k, start, before, total FROM o")
def _(t):
    return transcripts.cds_offsets(t.v_tx, ["doc_id"]).select("doc_id", "k", "start", "before", "total")


@query("genome_slice", "SELECT doc_id, k, substr(q, start, \"end\" - start + 1) AS bases FROM (SELECT t.doc_id, k, start, \"end\", q FROM {v_tx} t JOIN {v_dna} d ON t.doc_id = d.doc_id)")
def _(t):
    tiled = transcripts.tiles(t.v_dna, "doc_id", "q", 64)
    return transcripts.slices(t.v_tx.withColumn("contig", F.col("doc_id")), tiled.withColumnRenamed("doc_id", "contig"), "contig", 64, ["doc_id", "k"])


@query("revcomp", f"SELECT doc_id, {rc('q')} AS rc FROM {{v_dna}}")
def _(t):
    return t.v_dna.select("doc_id", sq.reverse_complement(F.col("q")).alias("rc"))


@query("codon_translate", f"SELECT codon, count(*) AS n, {aa_of('codon')} AS aa FROM (SELECT unnest(regexp_extract_all(q, '...')) AS codon FROM {{v_dna}}) GROUP BY codon")
def _(t):
    return t.v_dna.select(F.explode(sq.codons(F.col("q"))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n")).withColumn("aa", sq.amino_acid(F.col("codon")))


ORIENTED = f"CASE WHEN doc_id % 2 = 0 THEN q ELSE {rc('q')} END"


@query("translate_cds", f"SELECT doc_id, CASE WHEN frame <> 0 THEN 'X' ELSE '' END || split_part({aa_text('b')}, '*', 1) AS aa FROM (SELECT doc_id, doc_id % 3 AS frame, substr({ORIENTED}, doc_id % 3 + 1) AS b FROM {{v_dna}})")
def _(t):
    return t.v_dna.select("doc_id", sq.translate_cds(F.col("q"), (F.col("doc_id") % 3).cast("int"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-")).alias("aa"))


@query("strand_infer", f"""WITH c AS {CDS}, p AS (SELECT doc_id, cds, split_part({aa_text('cds')}, '*', 1) AS aa FROM c), g AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'MMM' ELSE aa END AS aa, CASE WHEN doc_id % 2 = 0 THEN cds ELSE {rc('cds')} END AS genomic FROM p)
SELECT doc_id, CASE WHEN split_part({aa_text('genomic')}, '*', 1) = aa THEN '+' WHEN split_part({aa_text(rc('genomic'))}, '*', 1) = aa THEN '-' ELSE '.' END AS strand FROM g""")
def _(t):
    c = coding(t)
    rows = c.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "MMM").otherwise(F.substring_index(sq.translate(F.col("cds")), "*", 1)).alias("aa"), F.when(F.col("doc_id") % 2 == 0, F.col("cds")).otherwise(sq.reverse_complement(F.col("cds"))).alias("genomic"))
    return rows.select("doc_id", transcripts.inferred_strand(F.col("genomic"), F.col("aa")).alias("strand"))


@query("refseq_consistency", f"""WITH c AS {CDS}, p AS (SELECT doc_id, cds, {aa_text('cds')} AS whole FROM c), r AS (SELECT doc_id, cds, split_part(whole, '*', 1) AS translated, CASE WHEN doc_id % 3 = 0 THEN split_part(whole, '*', 1) WHEN doc_id % 3 = 1 THEN replace(whole, '*', 'U') ELSE whole || 'K' END AS aa FROM p)
SELECT doc_id FROM r WHERE length(aa) = length(translated) OR length(cds) // 3 * 3 - CASE WHEN substr(cds, length(cds) // 3 * 3 - 2, 3) IN ('TAA', 'TGA', 'TAG') THEN 3 ELSE 0 END = 3 * length(aa)""")
def _(t):
    rows = coding(t).withColumn("whole", sq.translate(F.col("cds"))).withColumn("translated", F.substring_index("whole", "*", 1))
    rows = rows.withColumn("aa", F.when(F.col("doc_id") % 3 == 0, F.col("translated")).when(F.col("doc_id") % 3 == 1, F.replace("whole", F.lit("*"), F.lit("U"))).otherwise(F.concat("whole", F.lit("K"))))
    return rows.where(transcripts.consistent(F.col("aa"), F.col("translated"), F.col("cds"), F.lit(0))).select("doc_id")


@query("nonstandard_stop", f"WITH c AS {CDS}, p AS (SELECT doc_id, length(cds) AS n, {aa_text('cds')} AS aa FROM c), r AS (SELECT doc_id, n, length(split_part(aa, '*', 1)) AS full_, CASE WHEN doc_id % 2 = 0 THEN length(split_part(aa, '*', 1)) // 2 ELSE length(split_part(aa, '*', 1)) END AS have FROM p) SELECT doc_id, CAST(have < full_ AND n / 3.0 - have > 1 AS int) AS nonstandard FROM r")
def _(t):
    rows = coding(t).select("doc_id", F.length("cds").alias("n"), F.length(F.substring_index(sq.translate(F.col("cds")), "*", 1)).alias("full"))
    have = F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("full") / 2)).otherwise(F.col("full"))
    return rows.select("doc_id", annotate.nonstandard_stop(have, F.col("full"), F.col("n")).cast("int").alias("nonstandard"))


# Edits in coding sequences: one at an offset, as edited_bases has it.
EDITED = EDIT_RECORDS.rstrip() + f""",
o AS {OFFSETS}, c AS {CDS},
h AS (SELECT e.doc_id, e.variant_id, e.ref, e.alt, CASE WHEN o.strand = '-' THEN total - 1 - (e.pos - start + before) ELSE e.pos - start + before END AS i FROM er e JOIN o ON e.doc_id = o.doc_id AND e.pos BETWEEN start AND "end"),
one AS (SELECT doc_id, i, ref, arg_min(alt, variant_id) AS alt, min(variant_id) AS variant_id FROM h GROUP BY doc_id, i, ref),
b AS (SELECT doc_id, unnest(range(length(cds))) AS i, unnest(string_split(cds, '')) AS base FROM c WHERE length(cds) > 0),
n AS (SELECT b.doc_id, b.i, base, coalesce(alt, base) AS new, variant_id FROM b LEFT JOIN one ON b.doc_id = one.doc_id AND b.i = one.i AND b.base = one.ref),
eb AS (SELECT doc_id, i, base, CASE WHEN i < 2 AND new = '' AND max(CASE WHEN i = 2 AND new <> '' THEN 1 END) OVER (PARTITION BY doc_id) = 1 THEN base ELSE new END AS new, variant_id FROM n)
"""


def edited(t):
    rows = located(t, edits(t)).select("doc_id", F.col("offset").cast("int").alias("i"), "ref", "alt", "variant_id")
    return annotate.with_edits(with_protein(coding(t), ["doc_id"]), rows, ["doc_id"])


def bases(t):
    return annotate.edited_bases(edited(t), ["doc_id"])


@query("base_edit_join", EDITED + "SELECT doc_id, CAST(i AS int) AS i, base, new, variant_id FROM eb")
def _(t):
    return bases(t)


@query("direct_translate", EDITED + f", s AS (SELECT doc_id, string_agg(new, '' ORDER BY i) AS new_cds FROM eb GROUP BY doc_id) SELECT doc_id, new_cds, split_part({aa_text('new_cds')}, '*', 1) AS new_aa FROM s")
def _(t):
    return annotate.retranslated(edited(t), ["doc_id"])


@query("alt_bases_explode", EDITED + "SELECT doc_id, CAST(i AS int) AS i, CAST(k - 1 AS int) AS k, substr(new, k, 1) AS base FROM (SELECT doc_id, i, new, unnest(range(1, length(new) + 1)) AS k FROM eb)")
def _(t):
    return annotate.edited_letters(edited(t), ["doc_id"])


# variants of a codon in order, each once: by the first of its places
def codons_sql(source: str, order: str) -> str:
    return f"""SELECT g.doc_id, g.codon_no, locus, codon, coalesce(variants, '') AS variants FROM
(SELECT doc_id, n // 3 + 1 AS codon_no, arg_min(i, n) AS locus, string_agg(base, '' ORDER BY n) AS codon FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1 AS n FROM {source}) GROUP BY doc_id, n // 3 + 1 HAVING count(*) = 3) g
LEFT JOIN (SELECT doc_id, codon_no, string_agg(variant_id, ',' ORDER BY f) AS variants FROM (SELECT doc_id, n // 3 + 1 AS codon_no, variant_id, min(n) AS f FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1 AS n FROM {source}) WHERE variant_id IS NOT NULL GROUP BY doc_id, n // 3 + 1, variant_id) GROUP BY doc_id, codon_no) v ON g.doc_id = v.doc_id AND g.codon_no = v.codon_no"""


SINGLE = "(SELECT doc_id, i, k, substr(new, k, 1) AS base, variant_id FROM (SELECT doc_id, i, new, variant_id, unnest(range(1, length(new) + 1)) AS k FROM eb))"
ALIGNED = EDITED + f""", p AS (SELECT doc_id, split_part({aa_text('cds')}, '*', 1) AS aa FROM c), pr AS (SELECT * FROM p WHERE aa <> ''),
rc0 AS ({codons_sql('eb', 'i')}), rf AS (SELECT r.doc_id, r.locus, r.codon AS codon_ref, substr(aa, r.codon_no, 1) AS aa_ref, r.codon_no AS aa_index, r.variants AS variants_ref, length(aa) AS len FROM rc0 r JOIN pr ON r.doc_id = pr.doc_id WHERE r.codon_no <= length(aa)),
ac AS ({codons_sql(SINGLE, 'i, k')}),
al0 AS (SELECT a.doc_id, a.codon_no AS n, a.locus, a.codon AS codon_alt, a.variants, variants_ref, codon_ref, aa_ref, aa_index, row_number() OVER (PARTITION BY a.doc_id, a.locus ORDER BY a.codon_no) AS once FROM ac a LEFT JOIN rf ON a.doc_id = rf.doc_id AND a.locus = rf.locus),
al1 AS (SELECT doc_id, n, locus, codon_alt, variants, variants_ref, CASE WHEN once = 1 THEN codon_ref END AS codon_ref, CASE WHEN once = 1 THEN aa_ref END AS aa_ref, CASE WHEN once = 1 THEN aa_index END AS aa_index FROM al0),
al AS (SELECT *, CASE WHEN codon_alt = codon_ref THEN aa_ref ELSE {aa_of('codon_alt')} END AS aa_alt, last_value(aa_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM al1)
"""


@query("codon_group", EDITED + ", sc AS (" + codons_sql("eb", "i") + ") SELECT doc_id, codon_no, CAST(locus AS bigint) AS locus, codon, variants FROM sc")
def _(t):
    return annotate.codon_groups(edited(t), ["doc_id"])


def aligned(t, *columns, **how):
    return annotate.aligned_codons(edited(t), ["doc_id"], columns, **how)


@query("codon_join", ALIGNED + "SELECT doc_id, n, CAST(locus AS bigint) AS locus, codon_alt, codon_ref, aa_ref, aa_alt FROM al")
def _(t):
    return aligned(t, "n", "locus", "codon_alt", "codon_ref", "aa_ref", "aa_alt")


@query("codon_first_use", ALIGNED + "SELECT doc_id, aa_index, count(*) AS uses, min(n) AS first_n FROM al WHERE aa_index IS NOT NULL GROUP BY doc_id, aa_index")
def _(t):
    return annotate.first_uses(edited(t), ["doc_id"])


@query("truncate_at_stop", ALIGNED + ", s AS (SELECT *, min(CASE WHEN aa_alt = '*' THEN n END) OVER (PARTITION BY doc_id) AS first_stop FROM al) SELECT doc_id, n, filled, aa_alt FROM s WHERE n < first_stop OR first_stop IS NULL")
def _(t):
    return aligned(t, "n", "filled", "aa_alt", to_stop=True)


@query("deleted_positions", ALIGNED + "SELECT doc_id, aa_index FROM rf EXCEPT SELECT doc_id, filled FROM al")
def _(t):
    return annotate.deleted_residues(edited(t), ["doc_id"])


CHANGES = ALIGNED + """, lr AS (SELECT doc_id, arg_max(locus, aa_index) AS last_locus, max(len) AS len FROM rf GROUP BY doc_id),
w0 AS (SELECT al.*, len, last_locus, aa_alt = '*' AS stop, aa_alt = '*' AND n <= len AND coalesce(aa_ref <> '*', true) AND (variants <> '' OR variants_ref IS NOT NULL) AS gained FROM al JOIN lr ON al.doc_id = lr.doc_id),
w1 AS (SELECT *, min(CASE WHEN locus = last_locus THEN n END) OVER d AS last_n, count(CASE WHEN locus = last_locus THEN 1 END) OVER d AS n_last, min(CASE WHEN stop THEN n END) OVER d AS first_stop, min(CASE WHEN gained THEN n END) OVER d AS gain_n FROM w0 WINDOW d AS (PARTITION BY doc_id)),
w2 AS (SELECT *, n_last <> 1 OR coalesce(max(CASE WHEN n = first_stop AND aa_ref IS NULL AND n <= last_n THEN 1 END) OVER d, 0) = 1 AS frame_change, coalesce(max(CASE WHEN n = last_n + 1 AND NOT stop THEN 1 END) OVER d, 0) = 1 AS lost FROM w1 WINDOW d AS (PARTITION BY doc_id)),
w3 AS (SELECT *, least(coalesce(first_stop - 1, 1::bigint << 40), CASE WHEN lost THEN last_n ELSE 1::bigint << 40 END) AS end0 FROM w2),
w4 AS (SELECT *, CASE WHEN frame_change THEN coalesce(max(CASE WHEN aa_ref IS NOT NULL AND n <= end0 THEN n END) OVER (PARTITION BY doc_id), 0) ELSE end0 END AS end1 FROM w3),
ch AS (SELECT doc_id, split_part(string_agg(aa_alt, '' ORDER BY n), '*', 1) AS new_aa, bool_or(frame_change) AS frame_change, bool_or(gain_n IS NOT NULL) AS stop_gain,
coalesce(max(CASE WHEN n = gain_n THEN coalesce(aa_ref, '-') || coalesce(CAST(filled AS varchar), '') || '*(' || CASE WHEN variants <> '' THEN variants ELSE coalesce(variants_ref, '') END || ')' END), '') AS aa_stop_gain,
bool_or(lost) AS stop_loss, coalesce(max(CASE WHEN lost AND n = last_n + 1 THEN CAST(filled AS varchar) || '(' || variants || ')' END), '') AS stop_loss_pos,
count(CASE WHEN n <= end1 AND aa_ref IS NOT NULL AND aa_ref <> aa_alt AND variants <> '' THEN 1 END) AS n_variant_aa, coalesce(string_agg(CASE WHEN n <= end1 AND aa_ref IS NOT NULL AND aa_ref <> aa_alt AND variants <> '' THEN aa_ref || CAST(filled AS varchar) || aa_alt || '(' || variants || ')' END, ';' ORDER BY n), '') AS variant_aa,
count(CASE WHEN n <= end1 AND aa_ref IS NULL THEN 1 END) AS n_insertion_aa, coalesce(string_agg(CASE WHEN n <= end1 AND aa_ref IS NULL THEN '-' || CAST(filled AS varchar) || aa_alt || '(' || variants || ')' END, ';' ORDER BY n), '') AS insertion_aa,
max(CASE WHEN n <= end1 THEN filled END) AS seen_to, max(CASE WHEN n = gain_n THEN filled END) AS gain_at, count(aa_index) AS aligned_ FROM w4 GROUP BY doc_id HAVING count(aa_index) > 0),
gone AS (SELECT r.doc_id, count(*) AS n_deletion_aa, string_agg(aa_ref || CAST(aa_index AS varchar) || '-(' || variants_ref || ')', ';' ORDER BY aa_index) AS deletion_aa FROM rf r JOIN ch ON r.doc_id = ch.doc_id
WHERE (gain_at IS NULL OR aa_index < gain_at) AND (NOT frame_change OR aa_index <= coalesce(seen_to, 0)) AND NOT EXISTS (SELECT 1 FROM w4 WHERE w4.doc_id = r.doc_id AND w4.filled = r.aa_index AND w4.n <= w4.end1) GROUP BY r.doc_id),
res AS (SELECT ch.*, coalesce(n_deletion_aa, 0) AS n_deletion_aa, coalesce(deletion_aa, '') AS deletion_aa FROM ch LEFT JOIN gone ON ch.doc_id = gone.doc_id)
"""


def changes(t):
    return annotate.changes(edited(t), ["doc_id"])


def with_changes(t):
    """All proteins (doc_id, aa) beside their changes, null where they have none."""
    return annotate.changes(edited(t).where("aa is not null"), ["doc_id", "aa"], every=True)


@query("complex_translate", CHANGES + "SELECT doc_id, new_aa FROM res")
def _(t):
    return changes(t).select("doc_id", "new_aa")


@query("stop_gain", CHANGES + "SELECT doc_id, stop_gain, aa_stop_gain FROM res")
def _(t):
    return changes(t).select("doc_id", "stop_gain", "aa_stop_gain")


@query("stop_loss", CHANGES + "SELECT doc_id, stop_loss, stop_loss_pos FROM res")
def _(t):
    return changes(t).select("doc_id", "stop_loss", "stop_loss_pos")


@query("frame_change", CHANGES + "SELECT doc_id, frame_change FROM res")
def _(t):
    return changes(t).select("doc_id", "frame_change")


@query("aa_change_counts", CHANGES + "SELECT doc_id, n_variant_aa, n_deletion_aa, n_insertion_aa, variant_aa, deletion_aa, insertion_aa FROM res")
def _(t):
    return changes(t).select("doc_id", "n_variant_aa", "n_deletion_aa", "n_insertion_aa", "variant_aa", "deletion_aa", "insertion_aa")


@query("aa_mutations", CHANGES + "SELECT res.doc_id, CASE WHEN res.doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, frame_change, stop_gain, stop_loss, n_variant_aa, n_deletion_aa, n_insertion_aa, length(aa) AS len_ref_aa, length(new_aa) AS len_alt_aa FROM res JOIN pr ON res.doc_id = pr.doc_id WHERE new_aa <> aa")
def _(t):
    rows = with_changes(t).where("new_aa <> aa")
    return rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), "frame_change", "stop_gain", "stop_loss", "n_variant_aa", "n_deletion_aa", "n_insertion_aa", F.length("aa").cast("bigint").alias("len_ref_aa"), F.length("new_aa").cast("bigint").alias("len_alt_aa"))
