"""Genomics-shaped views of the driver's tables, each in Spark SQL and, where that differs, in DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.sequence import AMINO_ACIDS

BASE = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def letters(name: str, old: str = "", new: str = "", *kept: str) -> Callable[[DataFrame], DataFrame]:
    """documents as (doc_id, kept, name): each text's letters A to Z, upper-cased and translated, in one pass over its bytes.
    A regular expression takes a hundred times as long."""
    upper = [c - 32 if 97 <= c <= 122 else c for c in range(256)]
    table = bytes(dict(zip(old.encode(), new.encode())).get(c, c) for c in upper)
    others = bytes(c for c in range(256) if not 65 <= upper[c] <= 90)
    kept = kept or ("lang", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or b"").translate(table, others) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", *kept)), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", *kept, name])

    def view(documents: DataFrame) -> DataFrame:
        kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in ("doc_id", *kept))
        return documents.select("doc_id", *kept, "text").mapInArrow(run, f"{kinds}, {name} string")

    return view


#: name: SQL, or (Spark SQL or a function of documents, DuckDB SQL). {x} names another view or a table.
VIEWS: dict[str, str | tuple[str | Callable[[DataFrame], DataFrame], str]] = {
    "v_letters": (letters("s"), """SELECT doc_id, lang, source, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM {documents}"""),
    "v_protein": (letters("aa", "BJOUXZ", "NLKCAQ"), """SELECT doc_id, lang, source, translate(s, 'BJOUXZ', 'NLKCAQ') AS aa FROM {v_letters}"""),
    "v_dna": (letters("q", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC", "lang"), """SELECT doc_id, lang, translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') AS q FROM {v_letters}"""),
    "v_line": "SELECT *, CAST(l_orderkey AS string) || '_' || CAST(l_linenumber AS string) || '_' || CAST(l_partkey AS string) || '_' || CAST(l_suppkey AS string) || '_' || CAST(CAST(round(l_extendedprice * 100) AS bigint) AS string) AS rid FROM {lineitem}",
    "v_gt": "SELECT rid, CAST(l_linenumber % 3 AS string) || CASE WHEN l_returnflag = 'N' THEN '|' ELSE '/' END || CASE WHEN l_partkey % 13 = 0 THEN '.' ELSE CAST(l_suppkey % 3 AS string) END || ':' || CAST(l_linenumber AS string) AS gt FROM {v_line}",
    "v_info": "SELECT rid, CASE WHEN l_linenumber = 7 THEN 'DP=3' ELSE 'AC=' || CAST(l_linenumber AS string) || ';AF=0.' || lpad(CAST(CAST(round(l_discount * 100) AS bigint) AS string), 2, '0') || ',0.' || lpad(CAST(l_partkey % 100 AS string), 2, '0') END AS info FROM {v_line}",
    "v_vcf_line": """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'chr' ELSE '' END || CASE l_suppkey % 26 WHEN 0 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'M' WHEN 25 THEN 'KI270' ELSE CAST(l_suppkey % 26 AS string) END
 || chr(9) || CAST(l_partkey AS string) || chr(9) || rid || chr(9) || substr('ACGT', CAST(l_linenumber % 4 + 1 AS int), 1)
 || chr(9) || substr('ACGT', CAST(l_partkey % 4 + 1 AS int), 1) || CASE WHEN l_suppkey % 3 = 0 THEN ',' || substr('ACGT', CAST(l_suppkey % 4 + 1 AS int), 1) WHEN l_suppkey % 5 = 0 THEN ',*' ELSE '' END
 || chr(9) || '.' || chr(9) || CASE WHEN l_returnflag = 'R' THEN 'LowQual' ELSE 'PASS' END || chr(9) || 'AC=' || CAST(l_linenumber AS string) || chr(9) || 'GT'
 || chr(9) || CAST(l_linenumber % 3 AS string) || CASE WHEN l_returnflag = 'N' THEN '|' ELSE '/' END || CAST(l_suppkey % 3 AS string) || ':35'
 || chr(9) || CASE WHEN l_partkey % 7 = 0 THEN './.' WHEN l_partkey % 5 = 0 THEN '.' WHEN l_partkey % 11 = 0 THEN '0/0' ELSE CAST(l_partkey % 2 AS string) || '|' || CAST(l_suppkey % 2 AS string) END AS value FROM {v_line}""",
    # the same fields as columns, for DuckDB
    "v_vcf": ("", "SELECT split_part(value, chr(9), 1) AS chrom, CAST(split_part(value, chr(9), 2) AS bigint) AS pos, split_part(value, chr(9), 3) AS id, split_part(value, chr(9), 4) AS ref, split_part(value, chr(9), 5) AS alt, split_part(value, chr(9), 7) AS filter, split_part(value, chr(9), 8) AS info, split_part(value, chr(9), 10) AS s1, split_part(value, chr(9), 11) AS s2 FROM {v_vcf_line}"),
    "v_variant": "SELECT rid AS variant_id, l_suppkey AS chr, l_partkey AS pos, l_partkey + l_linenumber - 1 AS pos_end FROM {v_line}",
    "v_block": "SELECT p_partkey AS protein_id, p_partkey % 10 AS chr, p_partkey - p_size AS start, p_partkey + p_size AS `end` FROM {part}",
    "v_gtf_line": """SELECT 'chr' || CAST(p_partkey % 10 AS string) || chr(9) || 'src' || chr(9) || CASE p_partkey % 4 WHEN 0 THEN 'gene' WHEN 1 THEN 'exon' ELSE 'CDS' END || chr(9) || CAST(p_partkey AS string) || chr(9) || CAST(p_partkey + p_size AS string)
 || chr(9) || '.' || chr(9) || CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END || chr(9) || CASE WHEN p_partkey % 4 >= 2 THEN CAST(p_size % 3 AS string) ELSE '.' END || chr(9)
 || 'gene_id "G' || CAST(p_partkey % 50 AS string) || '"; transcript_id "T' || CAST(p_partkey % 500 AS string) || '";' || CASE WHEN p_partkey % 4 >= 2 THEN ' protein_id "P' || CAST(p_partkey % 500 AS string) || '"; ' ELSE '' END || ' gene_id "H' || p_brand || '";' AS value FROM {part}
 UNION ALL SELECT '#!comment ' || r_name AS value FROM {region}""",
    "v_gtf": ("", """SELECT split_part(value, chr(9), 1) AS seqname, split_part(value, chr(9), 2) AS source, split_part(value, chr(9), 3) AS feature, CAST(split_part(value, chr(9), 4) AS bigint) AS start, CAST(split_part(value, chr(9), 5) AS bigint) AS "end", split_part(value, chr(9), 6) AS score, split_part(value, chr(9), 7) AS strand, TRY_CAST(split_part(value, chr(9), 8) AS int) AS frame, split_part(value, chr(9), 9) AS attributes FROM {v_gtf_line} WHERE value NOT LIKE '#%'"""),
    "v_model": """SELECT p_partkey % 500 AS tx, p_partkey AS line_no, p_partkey % 10 AS chrom, CASE WHEN p_partkey % 500 % 7 = 0 OR p_partkey % 3 > 0 THEN 'CDS' ELSE 'exon' END AS feature, p_partkey AS start, p_partkey + p_size AS `end`, CASE WHEN p_partkey % 500 % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(p_size % 3 AS int) AS frame FROM {part}""",
    "v_fasta": "SELECT 'D' || CAST(doc_id AS string) || '|' || lang || '|x ' || source || chr(10) || substr(aa, 1, 60) || chr(10) || substr(aa, 61) || '*' AS value FROM {v_protein} WHERE length(aa) > 0",
    # a block in each 60 bases of a document, from its beginning to its end, a multiple of three long; strand by parity
    "v_tx": (
        # a document's length is taken once, ahead of its blocks
        """SELECT doc_id, k, strand, start, `end` FROM (SELECT doc_id, k, n, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, 1 + (k - 1) * 60 + doc_id % 10 AS start, 1 + (k - 1) * 60 + doc_id % 10 + 20 + 3 * ((doc_id + k) % 4) AS `end`
 FROM (SELECT doc_id, length(s) AS n FROM {v_letters}) LATERAL VIEW explode(sequence(1, CAST(n div 60 AS int))) t AS k WHERE n >= 60) WHERE `end` <= n""",
        """SELECT doc_id, k, strand, start, `end` FROM (SELECT doc_id, k, length(q) AS n, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, 1 + (k - 1) * 60 + doc_id % 10 AS start, 1 + (k - 1) * 60 + doc_id % 10 + 20 + 3 * ((doc_id + k) % 4) AS `end`
 FROM (SELECT doc_id, q, CAST(unnest(range(1, length(q) // 60 + 1)) AS int) AS k FROM {v_dna} WHERE length(q) >= 60)) WHERE `end` <= n""",
    ),
    "v_snv0": tuple(f"""SELECT doc_id, pos, alt FROM (SELECT doc_id, pos, rid, substr('ACGT', CAST(l_linenumber % 4 + 1 AS int), 1) AS alt, row_number() OVER (PARTITION BY doc_id, pos ORDER BY rid) AS rn FROM (SELECT d.doc_id, 1 + (l_suppkey * 7919 + l_linenumber * 104729 + l_orderkey * 31) % n AS pos, rid, l_linenumber FROM {{v_line}} JOIN (SELECT doc_id, {n}) d ON l_partkey = d.doc_id WHERE n >= 60)) WHERE rn = 1""" for n in ("length(s) AS n FROM {v_letters}", "length(q) AS n FROM {v_dna}")),
    "v_snv": "SELECT doc_id, pos, ref, alt FROM (SELECT s.doc_id, pos, substr(q, CAST(pos AS int), 1) AS ref, alt FROM {v_snv0} s JOIN {v_dna} d ON s.doc_id = d.doc_id) WHERE ref <> alt",
    # substitutions, deletions of one to three bases and insertions, at most one at a position
    "v_edit": (
        # what an edit needs of the sequence, reached once: reaching a place takes time in proportion to it
        """SELECT doc_id, pos, substr(w, 1, CAST(n AS int)) AS ref, CASE WHEN kind = 1 THEN substr(w, 1, 1) WHEN kind = 2 THEN substr(w, 1, 1) || alt || substr('ACGTACGT', CAST(pos % 4 + 1 AS int), CAST(pos % 3 AS int)) ELSE alt END AS alt
 FROM (SELECT s.doc_id, pos, alt, w, pos % 5 AS kind, CASE WHEN pos % 5 = 1 THEN 2 + pos % 3 ELSE 1 END AS n FROM {v_snv0} s JOIN {v_dna} d ON s.doc_id = d.doc_id LATERAL VIEW explode(array(substr(q, CAST(pos AS int), 4))) t AS w) WHERE substr(w, 1, CAST(n AS int)) <> CASE WHEN kind = 1 THEN substr(w, 1, 1) ELSE alt END""",
        """SELECT doc_id, pos, substr(q, CAST(pos AS int), CAST(n AS int)) AS ref, CASE WHEN kind = 1 THEN substr(q, CAST(pos AS int), 1) WHEN kind = 2 THEN substr(q, CAST(pos AS int), 1) || alt || substr('ACGTACGT', CAST(pos % 4 + 1 AS int), CAST(pos % 3 AS int)) ELSE alt END AS alt
 FROM (SELECT s.doc_id, pos, alt, q, pos % 5 AS kind, CASE WHEN pos % 5 = 1 THEN 2 + pos % 3 ELSE 1 END AS n FROM {v_snv0} s JOIN {v_dna} d ON s.doc_id = d.doc_id) WHERE substr(q, CAST(pos AS int), CAST(n AS int)) <> CASE WHEN kind = 1 THEN substr(q, CAST(pos AS int), 1) ELSE alt END""",
    ),
    "v_mnv": "SELECT rid, l_partkey AS pos, substr('ACGTACGTAC', CAST(l_linenumber % 4 + 1 AS int), CAST(l_suppkey % 4 + 1 AS int)) AS ref, substr('ACCTAGGTAC', CAST(l_partkey % 4 + 1 AS int), CAST(l_linenumber % 4 + 1 AS int)) AS alt FROM {v_line}",
    "v_carrier": "SELECT DISTINCT l_partkey AS protein_id, CAST(o_custkey % 8 AS int) AS sample, CAST(l_partkey AS string) || ':' || CAST(l_suppkey % 3 AS string) AS variant_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    # changed forms of proteins: the first K becomes P, every third document's form is unchanged
    "v_form": "SELECT doc_id, aa, CASE WHEN doc_id % 3 = 0 THEN aa WHEN doc_id % 3 = 1 THEN replace(aa, 'HATIN', 'HATKN') ELSE replace(aa, 'THE', 'TRE') END AS new_aa FROM {v_protein}",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str, seen: dict[str, DataFrame] | None = None) -> DataFrame:
    seen = {} if seen is None else seen
    if name not in seen:
        if name in BASE:
            seen[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
            if callable(text):
                seen[name] = text(spark_view(spark, sf_dir, "documents", seen))
                return seen[name]
            needs = re.findall(r"\{(\w+)\}", text)
            seen[name] = spark.sql(text, **{n: spark_view(spark, sf_dir, n, seen) for n in needs})
    return seen[name]


class Tables:
    """The driver's tables and these views as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return spark_view(self.spark, self.sf_dir, name, self._seen)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in re.findall(r"\{(\w+)\}", text)})


def oracle(body: str) -> str:
    """DuckDB SQL with the views that {x} names put before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in re.findall(r"\{(\w+)\}", text):
            if n in VIEWS and n not in order:
                need(VIEWS[n] if isinstance(VIEWS[n], str) else VIEWS[n][1])
                order.append(n)

    need(body)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t).replace("`", '"')
    head = ",\n".join(f"{n} AS ({plain(VIEWS[n] if isinstance(VIEWS[n], str) else VIEWS[n][1])})" for n in order)
    body = plain(body.strip())
    if not head:
        return body
    return f"WITH {head},\n{body[4:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"


def aa_of(codon: str) -> str:
    """DuckDB SQL of a codon's amino acid."""
    at = lambda i: f"instr('TCAG', substr({codon}, {i}, 1))"
    return f"CASE WHEN length({codon}) = 3 AND translate({codon}, 'ACGT', '') = '' THEN substr('{AMINO_ACIDS}', ({at(1)} - 1) * 16 + ({at(2)} - 1) * 4 + {at(3)}, 1) ELSE 'X' END"


def aa_text(seq: str) -> str:
    """DuckDB SQL of a sequence's whole codons, translated."""
    return f"array_to_string(list_transform(regexp_extract_all({seq}, '...'), lambda c: {aa_of('c')}), '')"


def rc(seq: str) -> str:
    return f"translate(reverse({seq}), 'ACGT', 'TGCA')"
