import gc

import public_tokenizers
import pyarrow as pa

from kithline.llm import bpe_lexicon, workers
from kithline.llm.bpe_lexicon import Lexicon, Rules
from tests.llm.common import ROWS, documents


def _found(batches):
    """How many tables of bpe_lexicon live in this worker."""
    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, Lexicon | Rules) for x in gc.get_objects())], pa.int64())], ["n"])


def test_workers_keep_one_operators_tables(spark):
    """After bpe, workers of the next operator's tasks no longer hold bpe's rules, words and ids."""
    bpe_lexicon.encode(documents(spark, ROWS).repartition(4), public_tokenizers.path("word_bpe_49k.json")).collect()
    rows = spark.range(8).repartition(8)
    left = rows.mapInArrow(workers.sole("other", _found), "n long").collect()
    assert left and not any(r.n for r in left)


def test_tables_are_kept_for_their_owner():
    workers.kept("a")["x"] = 1
    assert workers.kept("a") == {"x": 1}
    assert workers.kept("b") == {} and workers.kept("a") == {}


def test_operators_of_the_pipeline_hand_back_what_their_tasks_leave():
    """Each function of the pipeline that runs in workers is handed over by sole."""
    import inspect

    from kithline.llm import decontaminate, frequent, simhash, similar, toxicity

    for module in (bpe_lexicon, decontaminate, frequent, simhash, similar, toxicity):
        text = inspect.getsource(module)
        assert text.count("mapInArrow(") == text.count("mapInArrow(sole("), module.__name__
