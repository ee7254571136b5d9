"""Operators for preparing training corpora. Nothing else in the library imports this package."""


def queries() -> dict:
    from . import avi_mjpeg, context_mixing, langid, line_quality, packing, simhash, source_mix, token_prefix, toxicity_fm, warc

    return {
        "op1_language_id": langid.query,
        "op2_simhash_near_dedup": simhash.query,
        "op3_line_quality": line_quality.query,
        "op4_context_mixing": context_mixing.query,
        "op5_avi_mjpeg": avi_mjpeg.query,
        "op6_source_mix": source_mix.query,
        "op7_vector_packing": packing.query,
        "op8_warc_ranges": warc.query,
        "op9_prefix_token_counts": token_prefix.query,
        "op10_toxicity_fm": toxicity_fm.query,
    }


def oracle_sql() -> dict[str, str]:
    from . import line_quality, source_mix, warc

    return {"op3_line_quality": line_quality.SQL, "op6_source_mix": source_mix.SQL, "op8_warc_ranges": warc.SQL}
