"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from skein.llm import chat, exact_dedup, html_text, huffman, jaccard_join, language_id, merkle, oracle, packing, pieces, quality

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_html_text": html_text.op4_html_text,
    "op5_token_file": huffman.op5_token_file,
    "op6_packing": packing.op6_packing,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "sentencepiece_unigram": pieces.sentencepiece_unigram,
    "op8_language_id": language_id.op8_language_id,
    "op9_chat_format": chat.op9_chat_format,
    "chat_parts": chat.chat_parts,
    "op10_merkle_prints": merkle.op10_merkle_prints,
    "language_id_pages": language_id.language_id_pages,
}
SQL = {
    "op2_ngram_jaccard_join": oracle.JACCARD,
    "op3_exact_dedup": exact_dedup.SQL,
    "op9_chat_format": oracle.CHAT,
    "chat_parts": oracle.CHAT_PARTS,
}
