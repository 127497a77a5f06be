"""The graph of named streams: deterministic ids, DOT export, and running a job in the background."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

SPACE = uuid.UUID(int=0x7D1DEF10)


@dataclass
class Node:
    id: str
    name: str
    operator: str
    inputs: tuple[Node, ...] = ()


@dataclass
class Graph:
    """Streams in the order they were made. A new object is the reset; there is no global graph."""

    name: str = "job"
    nodes: list[Node] = field(default_factory=list)

    def add(self, name: str, operator: str, inputs: tuple[Node, ...] = ()) -> Node:
        """The id depends on the graph's name and the node's place only, so equal programs have equal ids."""
        node = Node(str(uuid.uuid5(SPACE, f"{self.name}/{len(self.nodes)}")), name, operator, inputs)
        self.nodes.append(node)
        return node

    def to_dot(self) -> str:
        lines = [f"digraph {json.dumps(self.name)} {{"]
        lines += [f"  {json.dumps(n.id)} [label={json.dumps(n.name)}];" for n in self.nodes]
        lines += [f"  {json.dumps(i.id)} -> {json.dumps(n.id)};" for n in self.nodes for i in n.inputs]
        return "\n".join([*lines, "}"])


class Handle:
    """A job that runs in a thread: batch actions, or streaming queries that stop on shutdown."""

    def __init__(self, work: Callable[[], object], queries: tuple = ()):
        self.queries, self.error, self.result = queries, None, None

        def run() -> None:
            try:
                self.result = work()
            except Exception as error:  # raised again by wait()
                self.error = error

        self.thread = threading.Thread(target=run, daemon=True)
        self.thread.start()

    def wait(self, seconds: float | None = None):
        self.thread.join(seconds)
        for query in self.queries:
            query.awaitTermination(int(seconds or 0) or None) if seconds else query.awaitTermination()
        if self.error is not None:
            raise self.error
        return self.result

    join = wait

    def shutdown(self) -> None:
        for query in self.queries:
            query.stop()


def run(work: Callable[[], object]):
    """Run a job and wait for it."""
    return Handle(work).wait()


def run_async(work: Callable[[], object], queries: tuple = ()) -> Handle:
    return Handle(work, queries)
