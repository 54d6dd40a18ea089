"""op9 and op10: byte-level BPE round trip; token files."""
import public_tokenizers
from pyspark.sql import functions as F

from barloom.llm.byte_bpe import decode, encode, read_ranks
from barloom.llm.registry import query, table
from barloom.llm.token_files import read_tokens, write_tokens
from barloom.session import shared_dir


@query("op9_byte_bpe")
def op9_byte_bpe(spark, sf_dir, path=None):
    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    done = decode(coded, ranks, public_tokenizers.PATTERN)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_token_files")
def op10_token_files(spark, sf_dir, path=None):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared_dir(spark, "tokens")
    write_tokens(docs, path or public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
