"""The language model's size, and that training reads long texts whole."""

from leafmill.llm import gated_lm


def test_training_carries_state_through_a_long_text():
    lexicon = gated_lm.Lexicon([(b"a", 9), (b"", 1)], {}, 10, 2)
    text = b"a " * 5_000
    lessons = gated_lm.Reader(lexicon).lessons([text, None, b"a a"])
    assert [len(x) for x in lessons] == [5_001, 1, 3]
    ids, owner = gated_lm.packed(lessons)
    net = gated_lm.Network(lexicon.start(), lexicon.heads)
    begun = sum(int((w[1] & (w[-1] == 0)).sum()) for w in net.windows(ids, owner))
    assert begun == 1  # the text begins once


def test_the_network_has_its_full_size():
    assert (gated_lm.STATE, gated_lm.VOCABULARY, gated_lm.CLASS_WORDS) == (24, 2_048, 64)
