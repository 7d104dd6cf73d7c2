"""Registered queries of this subpackage and the SQL texts of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import bm25, chat, decontam, langid, licenses, masks, neardup, packing, pieces, reshard, structure, toxicity, urlfilter
from .common import read


def op3_decontamination(spark, d):
    return decontam.decontam_report(read(spark, d, "documents"), read(spark, d, "benchmark"))


def op2_license_scan(spark, d):
    return licenses.license_report(read(spark, d, "documents"))


def op1_toxicity(spark, d):
    return toxicity.toxicity_report(read(spark, d, "documents"), read(spark, d, "labels"))


def op6_language(spark, d):
    return langid.language_report(read(spark, d, "documents"))


def op9_near_dedup(spark, d):
    return neardup.near_duplicates(read(spark, d, "documents"))


def op10_sentencepiece(spark, d):
    return pieces.encode_report(read(spark, d, "documents"))


def op5_url_filter(spark, d):
    return urlfilter.url_report(read(spark, d, "pages"))


def op7_chat_format(spark, d):
    return chat.chat_report(read(spark, d, "conversations"))


def op8_reshard(spark, d):
    return reshard.shard_report(read(spark, d, "documents"))


def op4_topk_search(spark, d):
    return bm25.search_report(read(spark, d, "documents"))


def op11_structure_repair(spark, d):
    return structure.repair_report(read(spark, d, "conversations"))


def op12_ranked_search(spark, d):
    return masks.search_report(spark, d)


def op13_packing(spark, d):
    return packing.packing_report(read(spark, d, "documents"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_topk_search": op4_topk_search,
    "op5_url_filter": op5_url_filter,
    "op6_language": op6_language,
    "op7_chat_format": op7_chat_format,
    "op8_reshard": op8_reshard,
    "op9_near_dedup": op9_near_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_structure_repair": op11_structure_repair,
    "op12_ranked_search": op12_ranked_search,
    "op13_packing": op13_packing,
}
SQL = {
    "op12_ranked_search": masks.REPORT_SQL,
    "op11_structure_repair": structure.REPORT_SQL,
    "op4_topk_search": bm25.REPORT_SQL,
    "op7_chat_format": chat.REPORT_SQL,
    "op5_url_filter": urlfilter.REPORT_SQL,
    "op9_near_dedup": neardup.REPORT_SQL,
    "op2_license_scan": licenses.REPORT_SQL,
    "op3_decontamination": decontam.REPORT_SQL,
}
