import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, prose, stored
from tokenizers import Tokenizer

from usagelens.llm.token_files import decode_values, encode_values, read_token_files, round_trip, write_token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_values_round_trip(n):
    random.seed(n)
    values = np.array([random.getrandbits(random.choice([1, 8, 9, 16, 17, 24, 25, 32])) for _ in range(n)], np.uint32)
    control, data = encode_values(values)
    assert len(control) == -(-n // 4)
    assert len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values) + (-n % 4)
    assert decode_values(control, data, n).tolist() == values.tolist()


def ids_of(text):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_files_give_back_all_ids_in_order(spark, tmp_path):
    rows = [(1000 - i, prose(i % 90, i), "en", "a") for i in range(400)]
    folder = str(tmp_path / "files")
    write_token_files(stored(spark, tmp_path, rows), WORDS, folder, block_ids=500)
    got = read_token_files(spark, folder).collect()
    by = {r.doc_id: r for r in got}
    at = 0
    for doc_id, text, *_ in sorted(rows):
        ids = ids_of(text)
        assert np.frombuffer(by[doc_id].ids, "<u4").tolist() == ids and by[doc_id].start == at
        at += len(ids)
    blocks = spark.read.parquet(f"{folder}/blocks").orderBy("chunk", "before").collect()
    assert len(blocks) > 10 and [d for b in blocks for d in b.doc_ids] == sorted(r[0] for r in rows)


def test_awkward_rows(spark, tmp_path):
    got = round_trip(stored(spark, tmp_path, AWKWARD), WORDS).collect()
    want = sorted((str(d), len(ids_of(t)), zlib.crc32(np.array(ids_of(t), "<u4").tobytes())) for d, t, *_ in AWKWARD)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    assert [r.doc_id for r in ordered[:2]] == [None, None]


def test_empty_table(spark, tmp_path):
    assert round_trip(stored(spark, tmp_path, []), WORDS).collect() == []
