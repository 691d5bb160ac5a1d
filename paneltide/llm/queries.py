"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import collocations, decontaminate, fill_middle, fingerprint, language, language_model, licences, line_dedup, mixing, quality_rules, secrets, simhash, url_rules

QUERIES = {
    "op1_language_model": language_model.query,
    "op2_mixing": mixing.query,
    "op3_decontaminate": decontaminate.query,
    "op4_simhash": simhash.query,
    "op5_secrets": secrets.query,
    "op6_language": language.query,
    "op7_licences": licences.query,
    "op8_line_dedup": line_dedup.query,
    "op9_url_rules": url_rules.query,
    "op10_quality_rules": quality_rules.query,
    "op11_fill_middle": fill_middle.query,
    "op12_collocations": collocations.query,
    "op13_fingerprint": fingerprint.query,
}
ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op5_secrets": secrets.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_url_rules": url_rules.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
