"""The queries of this subpackage and their SQL."""

from motionmill.llm import bpe, chat, decontaminate, langid, media, pii, repair, sharding, simhash, toxicity, trie, urls, whiten

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_simhash": simhash.op2_simhash,
    "op3_jpeg": media.op3_jpeg,
    "op4_bpe": bpe.op4_bpe,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_repair": repair.op6_repair,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_pii": pii.op8_pii,
    "op9_linkgraph": urls.op9_linkgraph,
    "op10_slots": sharding.op10_slots,
    "op11_langid": langid.op11_langid,
    "op12_whitening": whiten.op12_whitening,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLES = {"op1_chat": chat.OP1_SQL, "op13_prefix_trie": trie.OP13_SQL}
