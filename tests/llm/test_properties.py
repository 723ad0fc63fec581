"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import imagecopies, licences, neardup, packing, spbpe, tokenfiles

few = settings(max_examples=60, deadline=None)


@few
@given(st.lists(st.integers(0, 65_535), min_size=1, max_size=300), st.integers(1, 20))
def test_token_files_come_back(ids, times):
    flat = np.array(ids * times, "<u2")
    found, sizes = tokenfiles.unpack_file(tokenfiles.pack_file(flat, np.array([len(ids)] * times)))
    assert (found == flat).all() and (sizes == len(ids)).all()


@few
@given(st.lists(st.integers(1, 50), max_size=120))
def test_bins_hold_every_piece_once(lengths):
    bins = packing.best_two_fit(np.array(lengths, int), 50)
    assert sorted(i for held in bins for i in held) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in held) <= 50 for held in bins)
    # two bins that together fit into one would have been one
    sums = sorted(sum(lengths[i] for i in held) for held in bins)
    assert len(sums) < 2 or sums[0] + sums[1] > 50


@few
@given(st.binary(max_size=60))
def test_pieces_come_back(token):
    assert spbpe.unmapped(spbpe.mapped(token)) == token and not any(c.isspace() for c in spbpe.mapped(token))


@few
@given(st.lists(st.text(alphabet="ab c", max_size=60), min_size=1, max_size=6))
def test_equal_multisets_have_equal_signatures(texts):
    found = neardup.sketch_texts([*texts, *texts[::-1]])
    n = len(texts)
    for i in range(n):
        assert found["sig"][i] == found["sig"][2 * n - 1 - i] and found["keys"][i] == found["keys"][2 * n - 1 - i]
        if texts[i].strip():
            assert neardup.overlap(texts[i], texts[i]) == 1.0


@few
@given(st.recursive(st.sampled_from(["mit", "gpl-2.0", "isc"]), lambda x: st.tuples(x, st.sampled_from(["and", "or"]), x), max_leaves=8))
def test_expressions_mean_what_they_say(tree):
    def text(t):
        return t if isinstance(t, str) else f"({text(t[0])} {t[1].upper()} {text(t[2])})"

    def value(t):
        if isinstance(t, str):
            return t in licences.ACCEPTED
        return (value(t[0]) and value(t[2])) if t[1] == "and" else (value(t[0]) or value(t[2]))

    assert licences.evaluate(licences.parse_expression(text(tree))[0])[1] == value(tree)


@few
@given(st.integers(1, 30), st.integers(1, 30))
def test_images_come_back(height, width):
    image = np.random.default_rng(height * 31 + width).integers(0, 256, (height, width)).astype(float)
    assert (imagecopies.decode_pnm(imagecopies.encode_pgm(image)) == image).all()
