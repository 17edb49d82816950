"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat_format, chat_repair, ngram_join, ogg_media, packing, prefix_trie, quality_gam, quality_rules, sharding, substring_dedup, suffix_repeats, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_warc": warc.op2_warc,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_packing": packing.op4_packing,
    "op5_quality_gam": quality_gam.op5_quality_gam,
    "op6_sharding": sharding.op6_sharding,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_ogg_media": ogg_media.op8_ogg_media,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_bpe": bpe.op10_bpe,
    "op11_chat_repair": chat_repair.op11_chat_repair,
    "op12_suffix_repeats": suffix_repeats.op12_suffix_repeats,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op2_warc": warc.ORACLE_SQL,
    "op3_chat_format": chat_format.ORACLE_SQL,
    "op7_ngram_join": ngram_join.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_chat_repair": chat_repair.op11_chat_repair,
    "op11_chat_repair": chat_repair.ORACLE_SQL,
    "op12_suffix_repeats": suffix_repeats.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
