"""What a worker keeps between the stages of a pipeline."""

import numpy as np

from heddlework.llm import common, pieces, toxicity
from heddlework.llm.queries import TOKENIZERS, VOCABULARY


def test_a_worker_keeps_the_models_of_one_operator():
    model, tokenizer = toxicity.Model(["stupid"], [], np.zeros(4)), pieces.Tokenizer(pieces.Vocabulary.load(f"{TOKENIZERS}/{VOCABULARY}"))
    lexicon = model.lexicon()
    assert model.lexicon() is lexicon
    matcher = tokenizer.matcher()
    assert tokenizer.matcher() is matcher and list(common._HELD.values()) == [matcher]
    assert model.lexicon() is not lexicon and len(common._HELD) == 1
    common.let_go()
    assert not common._HELD
