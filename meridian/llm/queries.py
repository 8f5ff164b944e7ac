"""The queries of this subpackage, by the name under which they are registered, and their SQL where DuckDB can say the same."""

from __future__ import annotations

import os

from . import chat, decontam, fingerprint, jaccard, langid, mixing, pii, secrets, sharding, toxicity
from ._common import table


def op1_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_chat_formatting(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chats(own.unionByName(extra)))


def op4_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op5_fingerprints(spark, sf_dir):
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op7_decontamination(spark, sf_dir):
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii_surrogates(spark, sf_dir):
    """Under the key that the session names; without one, under a new key that nobody keeps."""
    named = spark.conf.get("spark.meridian.pii.key", None)
    return pii.anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), named.encode() if named else os.urandom(32))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_source_mixing, op3_chat_formatting, op4_sharding, op5_fingerprints, op6_secret_scan, op7_decontamination, op8_pii_surrogates, op9_jaccard_join, op10_toxicity)}

_ESC = r"replace(replace(replace({0}, '\', '\\'), '###', '\h\h\h'), '</turn>', '\l/turn>')"
# Where a role of the conversation holds a colon and a blank, the roles' colons and line feeds are escaped too.
_ROLE = r"CASE WHEN conflict THEN replace(replace({0}, chr(10), '\n'), ':', '\c') ELSE {0} END".format(_ESC.format("role"))

ORACLE: dict[str, str] = {
    "op3_chat_formatting": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, bool_or(contains(role, ': ')) OVER (PARTITION BY conv_id) AS conflict FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length({_ROLE}) + 2 + length({_ESC.format("text")}) + 9) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id""",
}
