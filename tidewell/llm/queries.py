"""The registered queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, jaccard_join, kdtree, license_scan, lm, packing, pii, sql, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_decontaminate": decontaminate.op2,
    "op3_kdtree": kdtree.op3,
    "op4_suffix_dedup": suffix_dedup.op4,
    "op5_jaccard_join": jaccard_join.op5,
    "op6_pii": pii.op6,
    "op7_pack": packing.op7,
    "op8_warc": warc.op8,
    "op9_license_scan": license_scan.op9,
    "op10_lm": lm.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": sql.OP2,
    "op3_kdtree": kdtree.SQL,
    "op4_suffix_dedup": sql.OP4,
    "op5_jaccard_join": sql.OP5,
}
