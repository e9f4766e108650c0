"""Queries of the corpus operators, and their SQL where SQL can express them."""

from brinewood.llm import ann, chat, filters, langid, media, mixing, ngram_join, packing, pieces, quality, repair, secrets, sharding

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_shard_documents": sharding.op3_shard_documents,
    "op4_pack_sequences": packing.op4_pack_sequences,
    "op5_language_id": langid.op5_language_id,
    "op6_media_columns": media.op6_media_columns,
    "op7_quality": quality.op7_quality,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_nearest": ann.op9_nearest,
    "op10_chat_roles": chat.op10_chat_roles,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_filter_audit": filters.op12_filter_audit,
    "op13_conversation_repair": repair.op13_conversation_repair,
}
ORACLES = {"op1_secret_scan": secrets.ORACLE, "op12_filter_audit": filters.ORACLE, "op13_conversation_repair": repair.ORACLE}
