"""The queries of this subpackage, and SQL for those that SQL can express."""

from proofline.llm import ann, exact_dedup, fill_middle, html_text, langid, mixing, near_dedup, packing, pii, pitman_yor, token_files, vector_codes, warc

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mixing,
        html_text.op2_html_text,
        ann.op3_nearest,
        exact_dedup.op4_exact_dedup,
        pii.op5_pii,
        token_files.op6_token_files,
        langid.op7_langid,
        near_dedup.op8_near_dedup,
        warc.op9_warc,
        packing.op10_packing,
        fill_middle.op11_fill_in_middle,
        pitman_yor.op12_lm_scores,
        vector_codes.op13_vector_codes,
    )
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op8_near_dedup": near_dedup.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_fill_in_middle": fill_middle.OP11_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
