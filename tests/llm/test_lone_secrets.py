"""Secrets that a sensitive word opens, and secrets of one kind of character."""

import random
import string

import pytest

from ioloom.llm import secret_scan

SECRET = "8fK2mQ9zR4tV7wY1"
LETTERS = "qZvKbXwRtLpHsNdJ"


def found(text):
    return [text[a:b] for a, b, k in secret_scan.spans_of(text, text.encode()) if k == "novel"]


@pytest.mark.parametrize("opening", ["token_", "session_", "auth=", "my-api_key-", "session_token_access_key_", "bearer"])
def test_a_sensitive_word_may_open_the_candidate(opening):
    text = f"we saw {opening}{SECRET} in the log"
    assert len(found(text)) == 1 and found(text)[0].endswith(SECRET)
    assert SECRET not in secret_scan.redacted(text, secret_scan.spans_of(text, text.encode()))


@pytest.mark.parametrize("before", ["Authorization: Bearer ", "the private key ", "token_"])
def test_secrets_without_digits_or_letters(before):
    assert found(f"{before}{LETTERS} was there") == [LETTERS]
    assert found(f"{before}8305917264402958 was there") == ["8305917264402958"]


def test_random_letters_are_mostly_found():
    rng = random.Random(2)
    draw = lambda: "".join(rng.choice(string.ascii_letters) for _ in range(24))
    assert sum(bool(found(f"the request had Bearer {draw()} in it")) for _ in range(200)) >= 196


@pytest.mark.parametrize("plain", ["internationalization", "characteristically", "authenticationHandler", "tokenization_of_the_text", "session_management_service", "key_================", "environment_variable_names", "keyboard_configuration_handler"])
def test_names_and_words_stay(plain):
    assert found(f"the key to the {plain} is in the manual") == []


def test_many_words_in_one_run_are_scanned_in_linear_time():
    text = "token" * 40000 + SECRET
    assert found(f"a {text}") in ([], [SECRET])
