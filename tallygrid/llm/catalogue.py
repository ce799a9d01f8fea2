"""Named queries of this package, and the SQL oracles of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, language, lexical, minhash, neighbours, packing, pseudonyms, sharding, simhash, suffixes, urls, whitening

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_url_filter": urls.op3_url_filter,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_minhash": minhash.op5_minhash,
    "op6_packing": packing.op6_packing,
    "op7_pii": pseudonyms.op7_pii,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_sharding": sharding.op9_sharding,
    "op10_language_id": language.op10_language_id,
    "op11_simhash": simhash.op11_simhash,
    "op12_lexical": lexical.op12_lexical,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op1_chat_format": chat.OP1_SQL,
    "op3_url_filter": urls.OP3_SQL,
    "op4_neighbours": neighbours.OP4_SQL,
    "op5_minhash": minhash.OP5_SQL,
    "op12_lexical": lexical.OP12_SQL,
}


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
