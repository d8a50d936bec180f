"""Slots, operator descriptors and chain search."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class Kind(Enum):
    QUERY_TEXT = "query_text"
    ENTITY_SET = "entity_set"
    RELATIONSHIP_SET = "relationship_set"
    CHUNK_SET = "chunk_set"
    SUBGRAPH = "subgraph"
    COMMUNITY_SET = "community_set"
    SCORE_VECTOR = "score_vector"


class Cost(Enum):
    FREE = 0
    CHEAP = 1
    MODERATE = 2
    EXPENSIVE = 3


@dataclass(frozen=True)
class Slot:
    """A typed value between operators: a question's text or a lazy frame."""

    kind: Kind
    data: Any
    producer: str = ""


@dataclass(frozen=True)
class Spec:
    """An operator's descriptor: slots by name, what it needs of the context, its cost and its function (inputs, context, params) -> outputs."""

    id: str
    inputs: dict[str, Kind]
    outputs: dict[str, Kind]
    run: Callable[[dict[str, Slot], Any, dict], dict[str, Slot]]
    optional: dict[str, Kind] = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    cost: Cost = Cost.FREE
    also: dict[str, tuple[Kind, ...]] = field(default_factory=dict)  # further kinds an input takes

    @property
    def category(self) -> str:
        return self.id.split(".")[0]

    def takes(self, name: str, kind: Kind) -> bool:
        return kind == {**self.inputs, **self.optional}.get(name) or kind in self.also.get(name, ())


class Registry:
    def __init__(self):
        self.specs: dict[str, Spec] = {}

    def register(self, spec: Spec) -> Spec:
        self.specs[spec.id] = spec
        return spec

    def get(self, id: str) -> Spec:
        if id not in self.specs:
            raise KeyError(f"no operator {id}")
        return self.specs[id]

    def by_category(self, category: str) -> list[Spec]:
        return [s for s in self.specs.values() if s.category == category]

    def successors(self, id: str) -> list[str]:
        """Operators that take one of this one's output kinds."""
        out = set(self.get(id).outputs.values())
        return sorted(s.id for s in self.specs.values() if out & set(s.inputs.values()))

    def predecessors(self, id: str) -> list[str]:
        need = set(self.get(id).inputs.values())
        return sorted(s.id for s in self.specs.values() if need & set(s.outputs.values()))

    def connects(self, a: str, out: str, b: str, name: str) -> bool:
        return out in self.get(a).outputs and self.get(b).takes(name, self.get(a).outputs[out])

    def chains(self, have: set[Kind], goal: Kind, depth: int = 5, needs: set[str] | None = None, most: int | None = None) -> list[list[str]]:
        """Chains of operators from kinds at hand to the goal, the shortest first.

        A chain is followed no further once it has the goal, and an operator that adds no kind ends
        none, so the search stays small.
        """
        found, queue = [], deque([(frozenset(have), [])])
        while queue and (most is None or len(found) < most):
            kinds, chain = queue.popleft()
            for s in sorted(self.specs.values(), key=lambda s: (s.cost.value, s.id)):
                if s.id in chain or not set(s.inputs.values()) <= kinds or (needs is not None and not set(s.needs) <= needs):
                    continue
                new = kinds | set(s.outputs.values())
                if goal in s.outputs.values():
                    found.append([*chain, s.id])
                elif new != kinds and len(chain) + 1 < depth:
                    queue.append((frozenset(new), [*chain, s.id]))
        return found
