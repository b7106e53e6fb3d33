import random

import pytest

from careline.llm.pieces import Decoder, Encoder, Vocabulary, decode, encode
from careline.llm.queries import model_file


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(model_file())


def test_best_score_against_all_segmentations():
    v = Vocabulary(("<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "bb"),
                   (0.0, -3.0, -3.5, -5.0, -5.5, -7.0, -2.0, -4.0, -7.5, -6.0),
                   tuple(range(1, 10)), (), 0)
    scores = {v.pieces[i]: v.scores[i] for i in v.matched}

    def best(text):
        if not text:
            return 0.0
        options = [scores[text[:n]] + best(text[n:]) for n in range(1, len(text) + 1)
                   if text[:n] in scores]
        if text[0] not in scores:
            options.append(min(scores.values()) - 10 + best(text[1:]))
        return max(options)
    rng, encoder = random.Random(0), Encoder(v)
    for _ in range(300):
        text = "".join(rng.choice("ab▁c") for _ in range(rng.randint(0, 12)))
        ids, score = encoder.best(text)
        assert score == best(text)
        assert len(ids) <= len(text)


def test_same_pieces_as_the_library_s_viterbi(vocabulary):
    model = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor

    proto = model.ModelProto()
    with open(model_file(), "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores, read as a unigram model
    other = SentencePieceProcessor(model_proto=proto.SerializeToString())
    encoder, rng = Encoder(vocabulary), random.Random(1)
    # No words that need a lone space sign: its score of -1e9 leaves the library's single-precision
    # sums no room for the other pieces.
    words = ["the", "Reinigung", "naïve", "x=1;", "thndre", "and", "Hello", "wörld", "a☃b"]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))
        assert encoder.encode(text).tolist() == other.nbest_encode_as_ids(text, 2)[0], text


def test_round_trips(vocabulary):
    encoder, decoder, rng = Encoder(vocabulary), Decoder(vocabulary), random.Random(2)
    for _ in range(300):
        text = "".join(chr(rng.choice([32, 32, 97, 101, 10, 233, 0x4E00, 0x1F600, 0, 127]))
                       for _ in range(rng.randint(0, 40)))
        assert decoder.decode(encoder.encode(text)) == text


def test_rows(docs_of):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (3, ""), (None, "▁x"), (4, "élan " * 100_000)]
    got = encode(docs_of(rows), model_file())
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == 6 and all(r.round_trip and r.n_ids == len(r.ids) for r in got.collect())
    assert by_id[2].ids == by_id[3].ids == []
    texts = {r.doc_id: r.text for r in decode(got, model_file()).collect()}
    assert texts == {1: "Hello  world\n", 2: "", 3: "", None: " x", 4: "élan " * 100_000}
    assert encode(docs_of([]), model_file()).count() == 0
