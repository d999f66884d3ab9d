"""Queries of the token store and of packing."""

from prescient.llm.common import table
from prescient.llm.packing import pack
from prescient.llm.registry import query
from prescient.llm.token_store import write_store
from prescient.llm.tokenizer import public_path

VOCABULARY = "byte_bpe_50k.json"
VOCABULARY_IDS = 50_257


@query("op3_token_store")
def op3_token_store(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    store = write_store(docs, public_path(VOCABULARY), end_id=0, ids_below=VOCABULARY_IDS)
    return store.read(store.lookup(docs), with_ids=False)


@query("op5_pack")
def op5_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_path(VOCABULARY), end_id=2,
                with_ids=False)
