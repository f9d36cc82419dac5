"""Scores do not depend on how many words are broadcast: every word has its counts."""

import pytest

from quern.llm import lm_score
from tests.llm import test_learned_operators as whole


@pytest.mark.parametrize("common", [0, 5, 300])
def test_lm_scores_with_few_common_words(spark, monkeypatch, common):
    monkeypatch.setattr(lm_score, "COMMON", common)
    whole.test_lm_scores(spark, monkeypatch, 3000, 2000)
