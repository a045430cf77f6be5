"""The registered queries of the operators and the SQL that DuckDB checks them with."""

from __future__ import annotations

from barloom.llm import bpe, collocations, decontaminate, fixity, langid, lines, neighbours, packing, simhash, substrings, suffixes, urls, whitening
from barloom.llm.common import table

QUERIES = {
    "op1_substring_dedup": lambda spark, sf: substrings.document_digests(table(spark, sf, "documents")),
    "op2_byte_bpe": lambda spark, sf: bpe.digests(table(spark, sf, "documents")),
    "op3_ann_tree": lambda spark, sf: neighbours.embedding_neighbours(table(spark, sf, "embeddings")),
    "op4_line_dedup": lambda spark, sf: lines.document_lines(table(spark, sf, "documents")),
    "op5_suffix_dedup": lambda spark, sf: suffixes.document_digests(table(spark, sf, "documents")),
    "op6_simhash": lambda spark, sf: simhash.document_components(table(spark, sf, "documents")),
    "op7_warc_fixity": lambda spark, sf: fixity.page_audit(table(spark, sf, "pages")),
    "op8_url_filter": lambda spark, sf: urls.page_verdicts(table(spark, sf, "pages")),
    "op9_decontamination": lambda spark, sf: decontaminate.document_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op10_language_id": lambda spark, sf: langid.document_languages(table(spark, sf, "documents")),
    "op11_whitening": lambda spark, sf: whitening.whiten(table(spark, sf, "embeddings")),
    "op12_collocations": lambda spark, sf: collocations.collocations(table(spark, sf, "documents")),
    "op13_packing": lambda spark, sf: packing.pack(table(spark, sf, "documents")),
}
ORACLES = {
    "op7_warc_fixity": fixity.ORACLE,
    "op8_url_filter": urls.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
