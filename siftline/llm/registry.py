"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, brown, decontam, digest, embeddings, minhash, pages, phrases, pii, ppm, tokenfile, urls, vectorcode


def queries() -> dict:
    new = {"op11_phrases": phrases.op11_phrases, "op12_vectors": embeddings.op12_vectors, "op13_codes": vectorcode.op13_codes}
    return {"op1_decontam": decontam.op1_decontam, "op2_pii": pii.op2_pii, "op3_minhash": minhash.op3_minhash, "op4_urls": urls.op4_urls, "op5_tokenfile": tokenfile.op5_tokenfile, "op6_ppm": ppm.op6_ppm, "op7_pages": pages.op7_pages, "op8_brown": brown.op8_brown, "op9_bpe": bpe.op9_bpe, "op10_digest": digest.op10_digest} | new


def oracle_sql() -> dict[str, str]:
    return {"op11_phrases": phrases.SQL_OP11, "op12_vectors": embeddings.SQL_OP12, "op13_codes": vectorcode.SQL_OP13}
