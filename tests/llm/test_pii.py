import re

import pytest

from souk.llm import pii
from souk.llm.queries import QUERIES

TEXT = ("Write to John.Smith@Mail2.Example.com or JOHN.SMITH@MAIL2.EXAMPLE.COM, call +1 (743) 555-3824 or +1 743 555 3824. "
        "IP 152.143.123.131; card 4111111111111111 and 4111-1111-1111-1111; SSN 123-45-6789; IBAN DE89 3704 0044 0532 0130 00. "
        "Mr. Ivan Petrov and Mr. Petrov met Frau Müller, госпожа Иванова Анна. Version 1.2.3.4.5, year 2024, 3.14.")


def kinds(t):
    return [(t[a:b], k) for a, b, k, _ in pii.find_entities(t)]


def test_shapes_found():
    assert kinds(TEXT) == [
        ("John.Smith@Mail2.Example.com", "email"), ("JOHN.SMITH@MAIL2.EXAMPLE.COM", "email"), ("+1 (743) 555-3824", "phone"),
        ("+1 743 555 3824", "phone"), ("152.143.123.131", "ip"), ("4111111111111111", "card"), ("4111-1111-1111-1111", "card"),
        ("123-45-6789", "ssn"), ("DE89 3704 0044 0532 0130 00", "iban"), ("Ivan", "name"), ("Petrov", "name"), ("Petrov", "name"),
        ("Müller", "name"), ("Иванова", "name"), ("Анна", "name")]
    assert kinds("plain words, 12 and 1999, v1.2") == [] and kinds("") == []


def test_format_gender_script_and_coreference():
    new, spans = pii.replace_entities(TEXT, {})
    again = kinds(new)
    old = dict(kinds(TEXT))
    assert [k for _, k in again] == [k for _, k in kinds(TEXT)] and not set(old) & {t for t, _ in again}
    mail, mail2, phone, phone2, ip, card, card2, ssn, iban, given, family, family2, *_ = [t for t, _ in again]
    assert mail.lower() == mail2.lower() and mail2.isupper()
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(phone) == digits(phone2) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone)
    assert digits(card) == digits(card2) and pii._luhn(digits(card)) == pii._luhn("4111111111111111") == 0
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", iban)
    assert family == family2 and given != family and given[-1] not in "ae"
    assert all(re.fullmatch("[А-ЯЁ][а-яё]+", t) for t, _ in again[-2:]) and again[-2][0][-1] in "аяоунеэ"
    assert pii.replace_entities(TEXT, {})[0] == new and pii.replace_entities(TEXT, {}, b"other key")[0] != new


def test_collisions_are_resolved(spark):
    def tiny(kind, value, attempt, key):             # very few values, to force collisions
        return f"v{(len(value) + attempt * (1 + sum(map(ord, value)) % 3)) % 97}"

    values = [("t", f"x{'y' * (i % 5)}{i}") for i in range(60)] + [("u", "x0"), ("t", "v7"), ("t", "v8")]
    out = pii.assign_attempts(spark.createDataFrame(values * 2, "type string, value string"), make=tiny).collect()
    assert sorted((r.type, r.value) for r in out) == sorted(values)
    made = [(r.type, r.surrogate) for r in out]
    assert len(set(made)) == len(made) and not set(made) & set(values)
    assert any(r.attempt for r in out)


def test_a_later_attempt_reaches_the_texts(docs_of, monkeypatch, clash):
    """Entities that had to move are replaced by their later surrogate everywhere."""
    rows = [(i, f"mail a{i}@b.example.com and 10.0.0.{i}") for i in range(30)] + [(99, "a3@b.example.com"), (100, None), (101, "")]
    docs = docs_of(rows, clash)
    real = pii.assign_attempts

    def moved(entities, key):
        from pyspark.sql import functions as F
        return real(entities, key).withColumn("attempt", F.when(F.col("value") == "a3@b.example.com", 2).otherwise(F.col("attempt")))
    monkeypatch.setattr(pii, "assign_attempts", moved)
    out, name = pii.pseudonymise(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    new = pii.surrogate("email", "a3@b.example.com", 2)
    assert new in got[3] and got[99] == new and got[100] is None and got[101] == ""
    assert set(docs.columns) < set(out.columns)


def test_query_leaves_no_entity_and_keeps_distinctness(spark, sf_dir, documents):
    text = {r.doc_id: r.text for r in documents.collect()}
    pairs, kept = {}, 0
    for r in QUERIES["op6_pii"](spark, sf_dir).collect():
        old, new = pii.find_entities(text[r.doc_id] or ""), pii.find_entities(r.text or "")
        assert sum(e.n for e in r.entities) == len(old)
        if not old:
            assert r.text == text[r.doc_id]
            kept += 1
            continue
        assert not {text[r.doc_id][a:b] for a, b, _, _ in old} & {r.text[a:b] for a, b, _, _ in new}
        assert [x[2] for x in old] == [x[2] for x in new]
        for x, y in zip(old, new):
            assert pairs.setdefault(x[2:], y[2:]) == y[2:]
    assert pairs and kept and len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())


def test_empty_table(docs_of):
    assert pii.pseudonymise(docs_of([]))[0].collect() == []


@pytest.mark.parametrize("kind,value", [("email", "a@b.co"), ("ip", "1.2.3.4"), ("phone", "+123456789"), ("card", "4111111111111111"),
                                        ("card", "4111111111111112"), ("name", "given:f:latin:anna"), ("name", "family:x:latin:smith")])
def test_attempts_give_many_surrogates(kind, value):
    made = {pii.surrogate(kind, value, k) for k in range(60)}
    assert len(made) > 40 and all(pii.surrogate(kind, value, 3) == pii.surrogate(kind, value, 3) for _ in range(2))


def test_further_mentions_of_a_name_are_the_same_entity():
    text = ("Petrov called. Mr. Ivan Petrov wrote; Petrov's note, PETROV and Ivan said. Petrova, petrov and Petrovsk stay. "
            "Ask Petrov@mail.example.com. Frau Anna Petrov came, Anna left.")
    new, spans = pii.replace_entities(text, {})
    assert [text[a:b] for a, b, *_ in spans] == ["Petrov", "Ivan", "Petrov", "Petrov", "PETROV", "Ivan", "Petrov@mail.example.com",
                                                  "Anna", "Petrov", "Anna"]
    assert len({v for a, b, k, v in spans if text[a:b].lower() == "petrov"}) == 1
    assert not re.search(r"\b(Petrov|PETROV|Ivan|Anna)\b", new) and "Petrova, petrov and Petrovsk stay" in new
    again = [(new[a:b], k) for a, b, k, _ in pii.find_entities(new)]
    assert [k for _, k in again] == [k for *_, k, _ in spans]
    names = [t for t, k in again if k == "name"]
    assert names[0] == names[2] == names[3] == names[4].capitalize() == names[7] and names[1] == names[5] and names[6] == names[8]


def test_a_name_has_all_its_capitalised_words():
    text = "Señora Ana Lucia Gomez Herrera came with Herr Karl Otto Emil Franz Weber Frau Müller and Mr. Don Smith."
    spans = pii.find_entities(text)
    assert [text[a:b] for a, b, *_ in spans] == ["Ana", "Lucia", "Gomez", "Herrera", "Karl", "Otto", "Emil", "Franz", "Weber", "Müller",
                                                  "Don", "Smith"]
    assert [text[a:b] for a, b, _, v in spans if v.startswith("family")] == ["Herrera", "Weber", "Müller", "Smith"]


def test_mentions_keep_one_surrogate_over_the_corpus(docs_of):
    rows = [(0, "Mr. Ivan Petrov wrote. Petrov said."), (1, "Petrov again, Mr. Petrov"), (2, "Petrov without a title stays")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs_of(rows))[0].collect()}
    family = re.fullmatch(r"Mr\. \w+ (\w+) wrote\. (\w+) said\.", got[0])
    assert family[1] == family[2] != "Petrov" and got[1] == f"{family[1]} again, Mr. {family[1]}" and got[2] == rows[2][1]
