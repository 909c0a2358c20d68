"""Units of a text, encoded apart, give the library's ids."""

import random

import numpy as np

from proofline.llm.tokens import Encoder, default_path


def test_ids_are_the_librarys():
    made = random.Random(7)
    signs = "abXé× '1²,.\n\t\r 's'll½ÿ_-ªɏ 中"
    texts = ["".join(made.choice(signs) for _ in range(made.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", " ", "a ", "it's I'lly 'sx", "x<|endoftext|>y", "word " * 5000]
    encoder = Encoder(default_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder._library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time from what is kept
        assert encoder.encode(texts) == want
