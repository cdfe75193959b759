"""Personal data in stretches of more tokens than are decoded in one row."""

import numpy as np
import pytest
from fathomline.llm import pii


@pytest.mark.parametrize("n", [2, 3, 16, 17, 513, 1200])
def test_parts_hand_on_their_state(n):
    rng = np.random.default_rng(n)
    crf = pii.Crf({}, rng.normal(size=(5, 4, len(pii.LABELS))), 2 * rng.normal(size=(len(pii.LABELS),) * 2))
    ids = rng.integers(0, 4, n)
    assert crf.viterbi_long(ids).tolist() == crf.viterbi(ids[None], np.array([n]))[0].tolist()


def test_phone_and_secret_at_token_512():
    crf = pii.default_crf()
    for tail in ("call (555) 123-4567 now", "password aB3dE5fG7hJ9kL1mN3pQ5r now"):
        alone = [tail[a:b] for a, _, b in pii.tag([tail], crf)[0]]
        assert alone
        for before in range(500, 513):
            line = "row 7 " * (before // 2) + "row " * (before % 2) + tail + " row 7" * 20
            assert len(pii.TOKEN.findall(line)) > 512
            assert [line[a:b] for a, _, b in pii.tag([line], crf)[0]] == alone, before
            assert [line[a:b] for a, _, b in pii.find_spans([line], crf)[0][1]] == alone
