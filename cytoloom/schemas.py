"""Fixed schemas of the tables. Positions are 0-based, intervals half-open, unless a name says pos1."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "contigs": "contig string, ordinal int, seq string, length bigint, md5 string",
    "reads": "ordinal bigint, name string, description string, seq string, qual string",
    "read_pairs": "ordinal bigint, shared_name string, seq1 string, qual1 string, seq2 string, qual2 string",
    "alignments": "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string, tags map<string,string>",
    "observations": "fragment_id string, segment int, contig string, position bigint, reference_base string, query_base string, base_quality int, mapping_quality int, strand string, context string",
    "meth_sites": "contig string, position bigint, strand string, context string, methylated bigint, unmethylated bigint, deleted bigint, different bigint",
    "cgmap": "contig string, nucleotide string, pos1 bigint, context string, dinucleotide string, level string, meth bigint, total bigint",
    "bedmethyl": "contig string, start bigint, end bigint, modification string, score bigint, strand string, thick_start bigint, thick_end bigint, color string, coverage bigint, percent string, meth bigint, unmeth bigint, other_mod bigint, deleted bigint, failed bigint, different bigint, no_call bigint",
    "intervals": "contig string, start bigint, end bigint",
    "sites": "sample string, contig string, start bigint, end bigint, modification string, strand string, meth bigint, total bigint",
    "placements": "read_id bigint, contig string, start bigint, end bigint, strand string, distance int, query_start int, query_end int, score int",
    "candidates": "read_id bigint, contig string, strand string, start bigint, proof_mask bigint",
}

NAMES = tuple(_DDL)


def schema(name: str) -> StructType:
    """The schema of a table; needs a running session, as parsing is Spark's."""
    return StructType.fromDDL(_DDL[name])
