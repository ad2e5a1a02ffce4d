"""Transactions that tests and demos run: bank, register, set, counter and list."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TypeVar

from keystrata.store import Store, Transaction

T = TypeVar("T")


def retried(store: Store, body: Callable[[Transaction], T], attempts: int = 50) -> T:
    """A body in a transaction of its own, again for as long as its error is retriable."""
    return store.run(body, attempts)


def account(number: int) -> bytes:
    return b"%020d" % number


def balances(tx: Transaction, accounts: list[int]) -> dict[int, int]:
    return {a: int(tx.get(account(a)) or b"0") for a in accounts}


def transfer(tx: Transaction, payer: int, payee: int, amount: int) -> bool:
    """False, and nothing written, where the payer lacks the amount."""
    held = balances(tx, [payer, payee])
    if payer == payee or held[payer] < amount:
        return False
    tx.put(account(payer), b"%d" % (held[payer] - amount))
    tx.put(account(payee), b"%d" % (held[payee] + amount))
    return True


def add(tx: Transaction, key: bytes, amount: int = 1) -> int:
    total = int(tx.get(key) or b"0") + amount
    tx.put(key, b"%d" % total)
    return total


def append(tx: Transaction, key: bytes, element: object) -> list:
    items = [*json.loads(tx.get(key) or b"[]"), element]
    tx.put(key, json.dumps(items).encode())
    return items


def write_all(tx: Transaction, values: dict[bytes, bytes]) -> None:
    for key, value in values.items():
        tx.put(key, value)
