"""Deterministic stand-ins for models, so that results can be checked."""

from __future__ import annotations

import hashlib


def fingerprint_model():
    """A generator that answers with the md5 of its prompt."""
    return lambda prompt: {"generated_text": hashlib.md5(prompt.encode()).hexdigest()}


def flaky_batch_model():
    """A model of lists that fails for every prompt the first time it sees it."""
    seen = set()

    def call(prompts):
        out = [hashlib.md5(p.encode()).hexdigest() if p in seen else RuntimeError("not yet") for p in prompts]
        seen.update(prompts)
        return out

    return call


def busy_model():
    """A service that refuses prompts whose length is a multiple of seven."""
    def call(prompt):
        if len(prompt) % 7 == 0:
            raise RuntimeError("busy")
        return hashlib.md5(prompt.encode()).hexdigest()

    return call


def chat_model():
    """A chat model that answers with the md5 of its messages and their roles."""
    return lambda messages: hashlib.md5("\n".join(f"{m['role']}: {m['content']}" for m in messages).encode()).hexdigest()


def named_model(llm):
    """A generator that answers with the md5 of its name, its share of tokens and its prompt."""
    return lambda prompt, max_tokens: hashlib.md5(f"{llm}|{max_tokens}|{prompt}".encode()).hexdigest()


def length_judge():
    """A judge that scores a prompt by its length."""
    return lambda prompt: f"{len(prompt) % 5}\nlength {len(prompt)}"


def vowel_model():
    """An embedder that counts the five vowels of each text."""
    return lambda texts: [[float(t.count(v)) for v in "aeiou"] for t in texts]


def vowel_logits():
    """Two logits per text: how many letters a and e it has, scaled down."""
    return lambda texts: [[t.count("a") / 100.0, t.count("e") / 100.0] for t in texts]
