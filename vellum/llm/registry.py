"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from vellum.llm import clustering, cooccurrence, leakage, linkage, neighbours, splitting, subjects, tokenizing

QUERIES = {
    "p1_found": linkage.p1_found,
    "p1_matches": linkage.p1_matches,
    "p7_found": leakage.p7_found,
    "p7_kinds": leakage.p7_kinds,
    "p8_found": subjects.p8_found,
    "p8_posteriors": subjects.p8_posteriors,
    "p4_found": splitting.p4_found,
    "p4_pieces": splitting.p4_pieces,
    "p4_file_pieces": splitting.p4_file_pieces,
    "p5_found": clustering.p5_found,
    "p5_clusters": clustering.p5_clusters,
    "p3_found": cooccurrence.p3_found,
    "p3_pairs": cooccurrence.p3_pairs,
    "p2_found": neighbours.p2_found,
    "p6_ids": tokenizing.p6_ids,
}

ORACLES: dict[str, str] = {
    "p3_found": cooccurrence.P3_FOUND,
}
