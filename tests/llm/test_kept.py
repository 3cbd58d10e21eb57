"""What operators keep in a worker."""

import gc

from kinweave.llm import common, sentencepieces


def test_pieces_kept_are_bounded():
    """Whatever a worker has met, it holds the ids of some 300,000 stretches at most, besides those of one batch."""
    import public_tokenizers

    v = sentencepieces.MergeVocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    per_batch = 20_000
    for at in range(0, 520_000, per_batch):
        v.encode([" ".join(f"q{k:x}" for k in range(at, at + per_batch))])
    assert len(v.cache) + len(v._older) <= 300_000 + 2 * per_batch
    assert sentencepieces.BATCH_BYTES <= 1_000_000


def test_another_operator_drops_the_pieces():
    try:
        sentencepieces._vocabularies["x"] = None
        common.without_cycles("sentencepieces")
        assert "x" in sentencepieces._vocabularies
        common.without_cycles()
        assert not sentencepieces._vocabularies
    finally:
        gc.enable()
