"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from . import dedup, knn, lexicon_bpe, licences, mixing, neardup, negatives, packing, quality, secrets, sharding, spelling, warc

QUERIES = {
    "op1_knn": knn.op1_knn,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_secrets": secrets.op3_secrets,
    "op4_jaccard_join": neardup.op4_jaccard_join,
    "op5_shard": sharding.op5_shard,
    "op6_exact_dedup": dedup.op6_exact_dedup,
    "op7_warc": warc.op7_warc,
    "op8_licences": licences.op8_licences,
    "op9_pack": packing.op9_pack,
    "op10_quality": quality.op10_quality,
    "op11_spelling": spelling.op11_spelling,
    "op12_negatives": negatives.op12_negatives,
    "op13_bpe": lexicon_bpe.op13_bpe,
}
SQL = {
    "op7_warc": warc.OP7_SQL,
    "op1_knn": knn.OP1_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op3_secrets": secrets.OP3_SQL,
    "op4_jaccard_join": neardup.OP4_SQL,
    "op6_exact_dedup": dedup.OP6_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_negatives": negatives.OP12_SQL,
}
