"""Small weighted finite-state transducers over token classes, and their composition."""

from __future__ import annotations

from dataclasses import dataclass

#: Classes of tokens that a clause is read as: other, insult, threat, target, negation, reporting verb.
OTHER, INSULT, THREAT, TARGET, NOT, REPORT = "o", "i", "h", "t", "n", "r"
#: What a match can come out as: a bare, targeted, negated or reported insult; a threat at a target.
BARE, AIMED, DENIED, TOLD, MENACE = "I", "G", "N", "R", "H"
ALPHABET = (OTHER, INSULT, THREAT, TARGET, NOT, REPORT, BARE, AIMED, DENIED, TOLD, MENACE)


@dataclass(frozen=True)
class Transducer:
    """``arcs[state, read]`` is (next state, written, weight); a missing arc copies its symbol, keeps the state and costs nothing."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def __matmul__(self, after: Transducer) -> Transducer:
        """The composition: what this one writes, ``after`` reads; weights add up. Only reachable pairs of states are built."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            a, b = todo.pop()
            for symbol in ALPHABET:
                a2, middle, w1 = self.step(a, symbol)
                b2, out, w2 = after.step(b, middle)
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                arcs[number[a, b], symbol] = (number[a2, b2], out, w1 + w2)
        return Transducer(arcs)

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        """What is written for each symbol, with its weight, from state 0."""
        state, out = 0, []
        for s in symbols:
            state, written, weight = self.step(state, s)
            out.append((written, weight))
        return out


def within(trigger: str, reach: int, change: dict[str, tuple[str, float]]) -> Transducer:
    """After ``trigger``, for ``reach`` tokens, the symbols in ``change`` become others at a weight."""
    arcs = {}
    for state in range(reach + 1):
        for symbol in ALPHABET:
            left = reach if symbol == trigger else max(0, state - 1)
            written, weight = change.get(symbol, (symbol, 0.0)) if state else (symbol, 0.0)
            arcs[state, symbol] = (left, written, weight)
    return Transducer(arcs)


def insults() -> Transducer:
    """Marks every insult as a match."""
    return Transducer({(0, INSULT): (0, BARE, 1.0)})


def threats(reach: int = 4) -> Transducer:
    """A target within reach after a threatening verb is menaced."""
    return within(THREAT, reach, {TARGET: (MENACE, 1.0)})


def targets(reach: int = 5) -> Transducer:
    """An insult within reach after a target is aimed at it."""
    return within(TARGET, reach, {BARE: (AIMED, 0.5)})


def negations(reach: int = 2) -> Transducer:
    """A match within reach after a negation is denied."""
    return within(NOT, reach, {BARE: (DENIED, -0.5), AIMED: (DENIED, -0.5), MENACE: (DENIED, -0.5)})


def reports(reach: int = 12) -> Transducer:
    """A match within reach after a reporting verb is told of, not made."""
    return within(REPORT, reach, {BARE: (TOLD, -0.5), AIMED: (TOLD, -0.5), MENACE: (TOLD, -0.5)})


def grammar() -> Transducer:
    """Insult, threat, target, negation and reported speech, composed in this order."""
    return insults() @ threats() @ targets() @ negations() @ reports()


def named_after(reach: int = 3) -> Transducer:
    """Read from the right: an insult that stands alone, within reach before a target, is aimed at it."""
    return targets(reach)


def read(machine: Transducer, mirrored: Transducer, symbols: list[str]) -> list[tuple[str, float]]:
    """What is written for each symbol by one machine from the left and then by another from the right; weights add up."""
    there = machine.run(symbols)
    back = mirrored.run([s for s, _ in reversed(there)])
    return [(s, w + paid) for (_, w), (s, paid) in zip(there, reversed(back), strict=True)]
