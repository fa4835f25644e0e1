"""Predicates on functions and modules, as column functions. A missing text, path or list holds nothing."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from traceloom.functions import strings

# What names tests, guards, privileges and reach.
TEST_FOLDER = "tests"
TEST_ATTRIBUTES = ("test", "expected_failure")
GUARD_PARAMETERS = ("cap", "admin", "treasury", "authority")
GUARD_BODY = ("assert!", "tx_context::sender", "ctx.sender", "sender(", "assert_sender", "authorize", "ensure_", "check_")
PRIVILEGED_NAMES = ("admin", "burn", "claim", "config", "create", "destroy", "fee", "mint", "owner", "pause", "set", "transfer", "treasury", "unpause", "update", "upgrade", "withdraw")
PRIVILEGED_BODY = ("balance::", "coin::", "dynamic_field", "event::emit", "object::new", "share_object", "transfer::", "tx_context::sender")
REACHABLE = ("public", "public(package)")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay, so that none of them turns into one of A-Z."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def holds_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds one of the words, A-Z in either case; found in one pass over the text."""
    return F.coalesce(ascii_lower(text).rlike("|".join(re.escape(word) for word in words)), F.lit(False))


def is_test(path: Column, attributes: Column) -> Column:
    """Whether a module is for tests, by a folder of its path or by an attribute."""
    folder = F.coalesce(F.array_contains(F.split(path, "/"), TEST_FOLDER), F.lit(False))
    return folder | F.coalesce(F.exists(attributes, lambda a: holds_any(a, TEST_ATTRIBUTES)), F.lit(False))


def has_ability(abilities: Column, ability: str) -> Column:
    return F.coalesce(F.array_contains(F.array_compact(abilities), ability), F.lit(False))


def is_guarded(signature: Column, body: Column) -> Column:
    """Whether a function's parameters or body check who calls; the signature's name and results don't count."""
    return holds_any(strings.function_parameters(signature), GUARD_PARAMETERS) | holds_any(body, GUARD_BODY)


def is_privileged(name: Column, body: Column) -> Column:
    """Whether a function's name or body tells of owned state."""
    return holds_any(name, PRIVILEGED_NAMES) | holds_any(body, PRIVILEGED_BODY)


def is_reachable(visibility: Column, is_entry: Column, is_callable: Column) -> Column:
    """Whether others can call a function."""
    return F.coalesce(visibility.isin(*REACHABLE), F.lit(False)) | F.coalesce(is_entry, F.lit(False)) | F.coalesce(is_callable, F.lit(False))
