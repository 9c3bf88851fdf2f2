"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from corpusloom.llm import alignment, ball_kmeans, bpe, flac, language, licenses, mixing, neighbours, ngram_join, pii, quality, secrets, url_filter

QUERIES = {
    "op7_ngram_join": ngram_join.query,
    "op4_flac": flac.query,
    "op9_neighbours": neighbours.query,
    "op10_pii": pii.query,
    "op5_language": language.query,
    "op2_bpe": bpe.query,
    "op3_licenses": licenses.query,
    "op8_secrets": secrets.query,
    "op1_url_filter": url_filter.query,
    "op6_mixing": mixing.query,
    "op13_ball_kmeans": ball_kmeans.query,
    "op12_alignment": alignment.query,
    "op11_quality": quality.query,
}

ORACLES = {
    "op7_ngram_join": ngram_join.ORACLE,
    "op9_neighbours": neighbours.ORACLE,
    "op3_licenses": licenses.ORACLE,
    "op8_secrets": secrets.ORACLE,
    "op1_url_filter": url_filter.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op13_ball_kmeans": ball_kmeans.ORACLE,
}
