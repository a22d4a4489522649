import public_tokenizers
import struct
from tokenizers import Tokenizer

from tests.llm.conftest import by_id
from tidewatch.llm.bpe import decode, encode, split_words

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t", "Hello, World's  best words", "<|endoftext|>a<|startoftext|> b", "é İ Σς ﬁ 가",
    "a\x1cb \x1f c\x85d e᠎f", "x" * 300, "the " * 4000 + "end", "\x00\x7f \U0001F600\U0001F468‍\U0001F469", "same", "same",
]


def expected(text):
    tokenizer = Tokenizer.from_file(PATH)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), struct.pack(f"<{len(ids)}I", *ids), tokenizer.decode(ids, skip_special_tokens=False)


def test_equals_the_library(make):
    docs = make([(i, t) for i, t in enumerate(TEXTS)] + [(11, "same"), (None, "no id")], "doc_id long, text string")
    got = by_id(decode(encode(docs, PATH, blocks=3), PATH), "doc_id", "n_tokens", "ids", "decoded")
    for i, text in enumerate(TEXTS):
        assert got[i][0][0] == expected(text)[0] and bytes(got[i][0][1]) == expected(text)[1] and got[i][0][2] == expected(text)[2]
    assert len(got[11]) == 2 and got[None][0][2] == expected("no id")[2]


def test_blocks_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    one, many = (by_id(encode(docs, PATH, blocks=n), "doc_id", "ids") for n in (1, 17))
    assert one == many
    both = encode(docs, PATH, blocks=5, with_text=True)
    assert by_id(both, "doc_id", "decoded") == by_id(decode(encode(docs, PATH), PATH), "doc_id", "decoded")


def test_empty_table(make):
    assert decode(encode(make([], "doc_id long, text string"), PATH), PATH).count() == 0


def test_words_are_cut_at_the_tokenizers_white_space():
    assert split_words("a\x1cb c　d\x85e") == ["a\x1cb", "c", "d", "e"]
