"""Secrets beside their names, without digits, short ones and such with punctuation."""

from rxweave.llm import secrets


def test_names_are_cut_and_short_secrets_found(spark):
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    letters = "qWzKxVjTbNmRtYpLsDfGhJkCvBn"
    texts = [
        (f"set TOKEN={key} here", key), (f"api_key={key}", key), (f"AWS_SECRET_ACCESS_KEY={key}", key), (f'"token": "{letters}"', letters),
        ("password = Xk7.q2Rv now", "Xk7.q2Rv"), ("secret='aZ4k@9Lm2'", "aZ4k@9Lm2"), ("PASSWORD=uT5x!8Qw3b", "uT5x!8Qw3b"),
        ("password: changeme", None), ("the token: something else", None), ("ThisDocumentServiceExample list", None),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in secrets.scan(docs, secrets.train(secrets.labelled_findings(spark))).collect():
        assert texts[r.doc_id][0][r.start_at : r.end_at] == r.candidate
        if r.is_secret:
            got.setdefault(r.doc_id, []).append(r.candidate)
    assert got == {i: [want] for i, (_, want) in enumerate(texts) if want}
