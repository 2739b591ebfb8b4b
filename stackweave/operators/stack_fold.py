"""The per-chunk stack fold: small pure-Python helpers that run inside Spark tasks.

A thread's rows are cut into chunks. `fold_chunk` replays one chunk from a known entry state and
emits frames. For threads with several chunks, `summarise_chunk` first reduces a chunk to the
few steps that reach below its own frames, and `entry_states` replays only those reduced steps
to find every chunk's entry state; the chunks are then folded side by side.

A frame is the list [function, location, isMain, time, trace, cpu, reason]: what is open and
where its visible interval began.
"""

from __future__ import annotations

from collections.abc import Iterable

from stackweave import schemas as S

FRAME_WIDTH = 7
# Steps of a chunk summary.
PUSH, ENTER, CUT_TO, RETURN, REMOVE, SAME_RETURN = range(6)

# What a row does to the stack of its kind.
NOTHING, CALL, RETURNS = range(3)


def find(stack: list, function: int) -> int:
    for index in range(len(stack) - 1, -1, -1):
        if stack[index][0] == function:
            return index
    return -1


class Counters:
    __slots__ = ("skipped", "ignored", "resyncs", "dropped")

    def __init__(self) -> None:
        self.skipped = self.ignored = self.resyncs = self.dropped = 0


def enter_caller(stack: list, caller: int, template: list | None, counters: Counters) -> None:
    """Make the caller the top frame: drop what is above it, or push it if it has a name."""
    at = find(stack, caller)
    if at >= 0:
        if at != len(stack) - 1:
            counters.dropped += len(stack) - at - 1
            counters.resyncs += 1
            del stack[at + 1:]
    elif template is not None:
        stack.append(template)
        counters.resyncs += 1


def leave(stack: list, function: int, same: bool, counters: Counters) -> tuple[list, int] | None:
    """Apply a return; gives the closed frame and its raw depth."""
    size = len(stack)
    if size == 0:
        counters.skipped += 1
        return None
    if same and not (size > 1 and stack[-1][0] == function and stack[-2][0] == function):
        counters.ignored += 1
        return None
    at = find(stack, function)
    if at < 0:
        if size == 1:
            counters.skipped += 1
            return None
        counters.resyncs += 1
        return stack.pop(), size - 1
    if at != size - 1:
        counters.dropped += size - at - 1
        counters.resyncs += 1
    frame = stack[at]
    del stack[at:]
    return frame, at


def restart(frames: Iterable[list], time: int, trace: int, cpu: int) -> None:
    for frame in frames:
        frame[3:7] = time, trace, cpu, S.REASON_TRACE_RESUME


def fold_chunk(rows, losses, state, is_last: bool, counters: Counters) -> list[tuple]:
    """Frames that a chunk emits; see `fold_open`."""
    return fold_open(rows, losses, state or (-1, -1, 0, 0, [], []), is_last, counters)[0]


def fold_open(rows, losses, state, is_last: bool, counters: Counters | None = None) -> tuple[list[tuple], tuple]:
    """Replay rows (tuples in thread order) and losses ((time, cpu) in time order).

    `state` is (active kind, last trace, last cpu, last time, user stack, kernel stack); gives
    the frames emitted and the state after the last row.
    """
    counters = counters or Counters()
    active, last_trace, last_cpu, last_time, user, kernel = state
    stacks = (user, kernel)
    frames: list[tuple] = []

    def emit(frame, depth, kind, time, trace, cpu, reason):
        if reason == S.REASON_END_OF_INPUT and not frame[2]:
            return
        frames.append((kind, depth, frame[3], max(time, frame[3]), frame[4], trace or frame[4],
                       frame[1], frame[5], cpu, frame[6], reason))

    def close_active(time, trace, cpu, reason):
        if active >= 0:
            stack = stacks[active]
            for depth in range(len(stack) - 1, -1, -1):
                emit(stack[depth], depth, active, time, trace, cpu, reason)

    def lose(time, cpu):
        close_active(time, max(last_trace, 0), last_cpu if last_trace >= 0 else cpu, S.REASON_AUX_LOSS)
        user.clear()
        kernel.clear()

    next_loss, loss_count = 0, len(losses)
    for (trace, time, cpu, kind, action, caller, callee, same, caller_location, callee_location,
         caller_named, caller_main, callee_main) in rows:
        while next_loss < loss_count and losses[next_loss][0] < time:
            lose(*losses[next_loss])
            active = -1
            next_loss += 1
        if active != kind:
            close_active(time, trace, cpu, S.REASON_TRACE_END)
            active = kind
            restart(stacks[kind], time, trace, cpu)
        stack = stacks[kind]
        if action == CALL:
            if not same:
                template = [caller, caller_location, caller_main, time, trace, cpu,
                            S.REASON_CALL] if caller_named else None
                enter_caller(stack, caller, template, counters)
            stack.append([callee, callee_location, callee_main, time, trace, cpu, S.REASON_CALL])
        elif action == RETURNS:
            closed = leave(stack, caller, same, counters)
            if closed:
                emit(closed[0], closed[1], kind, time, trace, cpu, S.REASON_RETURN)
        last_time, last_trace, last_cpu = time, trace, cpu
    while next_loss < loss_count:
        lose(*losses[next_loss])
        active = -1
        next_loss += 1
    if is_last:
        close_active(last_time, max(last_trace, 0), last_cpu, S.REASON_END_OF_INPUT)
    return frames, (active, last_trace, last_cpu, last_time, user, kernel)


class Summary:
    """One kind's effect of a chunk on an unknown stack below, as a list of reduced steps.

    Each step is [op, row index, *frame]. Steps after the last one that may have cut the unknown
    part are frames known to be on top; they are resolved on the spot, so a call that returns
    inside the chunk leaves no step behind.
    """

    def __init__(self) -> None:
        self.steps: list[list] = []
        self.known_from = 0       # steps[known_from:] are frames certainly on top
        self.cleared = False      # a loss emptied the stack: nothing unknown is left below
        self.restarted_at = -1
        self.restart_info = (0, 0, 0)

    def clear(self) -> None:
        self.steps.clear()
        self.known_from, self.cleared, self.restarted_at = 0, True, -1

    def restart(self, index: int, time: int, trace: int, cpu: int) -> None:
        self.restarted_at, self.restart_info = index, (time, trace, cpu)

    def _find(self, function: int) -> int:
        for at in range(len(self.steps) - 1, self.known_from - 1, -1):
            if self.steps[at][2] == function:
                return at
        return -1

    def _barrier(self, op: int, index: int, function: int) -> None:
        self.steps.append([op, index, function, 0, 0, 0, 0, 0, 0])
        self.known_from = len(self.steps)

    def push(self, index: int, frame: list) -> None:
        self.steps.append([PUSH, index, *frame])

    def enter(self, index: int, caller: int, template: list | None) -> None:
        at = self._find(caller)
        if at >= 0:
            del self.steps[at + 1:]
        elif self.cleared and self.known_from == 0:
            if template is not None:
                self.push(index, template)
        elif template is not None:
            self.known_from = len(self.steps)
            self.steps.append([ENTER, index, *template])
        else:
            self._barrier(CUT_TO, index, caller)

    def leave(self, index: int, function: int, same: bool) -> None:
        known = len(self.steps) - self.known_from
        closed_world = self.cleared and self.known_from == 0
        if same:
            if known and self.steps[-1][2] != function:
                return
            if known > 1 or closed_world:
                if known > 1 and self.steps[-2][2] == function:
                    self.steps.pop()
                return
            self._barrier(SAME_RETURN, index, function)
            return
        if self._find(function) >= 0:
            self.remove(index, function)
        elif closed_world:
            if known > 1:
                self.steps.pop()
        else:
            self._barrier(RETURN, index, function)

    def remove(self, index: int, function: int) -> None:
        at = self._find(function)
        if at >= 0:
            entered = self.steps[at][0] == ENTER
            del self.steps[at:]
            if entered:
                self._barrier(REMOVE, index, function)
        elif not (self.cleared and self.known_from == 0):
            self._barrier(REMOVE, index, function)

    def absorb(self, index: int, steps: list[int]) -> None:
        """Append the steps of a later chunk."""
        width = FRAME_WIDTH + 1
        for at in range(0, len(steps), width):
            op, frame = steps[at], steps[at + 1:at + width]
            if op == PUSH:
                self.push(index, frame)
            elif op == ENTER:
                self.enter(index, frame[0], frame)
            elif op == CUT_TO:
                self.enter(index, frame[0], None)
            elif op == REMOVE:
                self.remove(index, frame[0])
            else:
                self.leave(index, frame[0], op == SAME_RETURN)

    def flat(self) -> list[int]:
        out: list[int] = []
        for op, index, *frame in self.steps:
            if index < self.restarted_at:
                frame[3:7] = *self.restart_info, S.REASON_TRACE_RESUME
            out.append(op)
            out.extend(frame)
        return out


def summarise_chunk(rows, losses) -> dict:
    """Reduce a chunk to its two summaries and the facts the next chunks need."""
    sides = (Summary(), Summary())
    active, first = -1, None
    next_loss, loss_count = 0, len(losses)

    def lose():
        sides[0].clear()
        sides[1].clear()

    for index, (trace, time, cpu, kind, action, caller, callee, same, caller_location,
                callee_location, caller_named, caller_main, callee_main) in enumerate(rows):
        while next_loss < loss_count and losses[next_loss][0] < time:
            lose()
            active = -1
            next_loss += 1
        side = sides[kind]
        if first is None:
            first = (kind, time, trace, cpu)
        elif active != kind:
            side.restart(index, time, trace, cpu)
        active = kind
        if action == CALL:
            if not same:
                side.enter(index, caller, [caller, caller_location, caller_main, time, trace, cpu,
                                           S.REASON_CALL] if caller_named else None)
            side.push(index, [callee, callee_location, callee_main, time, trace, cpu, S.REASON_CALL])
        elif action == RETURNS:
            side.leave(index, caller, same)
    if next_loss < loss_count:
        lose()
        active = -1
    trace, time, cpu = rows[-1][:3]
    return _facts(sides, list(first), active, trace, time, cpu)


def _facts(sides, first, active, trace, time, cpu) -> dict:
    facts = {"active": active, "lastTrace": trace, "lastTime": time, "lastCpu": cpu, "first": first}
    for name, side in zip(("user", "kernel"), sides):
        facts[f"{name}Steps"] = side.flat()
        facts[f"{name}Cleared"] = int(side.cleared)
        facts[f"{name}Restart"] = list(side.restart_info) if side.restarted_at >= 0 else []
    return facts


def combine_summaries(summaries: list[dict]) -> dict:
    """The summary of several consecutive chunks as one."""
    sides = (Summary(), Summary())
    active = None
    for number, facts in enumerate(summaries):
        # Restarts come before the chunk's steps and only reach steps of earlier chunks.
        at = 2 * number
        kind, time, trace, cpu = facts["first"]
        if active is not None and active != kind:
            sides[kind].restart(at, time, trace, cpu)
        for name, side in zip(("user", "kernel"), sides):
            if facts[f"{name}Cleared"]:
                side.clear()
            if facts[f"{name}Restart"]:
                side.restart(at, *facts[f"{name}Restart"])
            side.absorb(at + 1, facts[f"{name}Steps"])
        active = facts["active"]
    last = summaries[-1]
    return _facts(sides, summaries[0]["first"], active, last["lastTrace"], last["lastTime"], last["lastCpu"])


def _replay(stack: list, steps: list[int], counters: Counters) -> None:
    width = FRAME_WIDTH + 1
    for at in range(0, len(steps), width):
        op, frame = steps[at], steps[at + 1:at + width]
        if op == PUSH:
            stack.append(frame)
        elif op == ENTER:
            enter_caller(stack, frame[0], frame, counters)
        elif op == CUT_TO:
            enter_caller(stack, frame[0], None, counters)
        elif op == RETURN:
            leave(stack, frame[0], False, counters)
        elif op == SAME_RETURN:
            leave(stack, frame[0], True, counters)
        else:
            index = find(stack, frame[0])
            if index >= 0:
                del stack[index:]


def entry_states(summaries: Iterable[dict], initial: list[int] | None = None):
    """Entry state of each of consecutive chunks, from their summaries and the state before them."""
    active, *last, user, kernel = unpack_state(initial) if initial else (-1, -1, 0, 0, [], [])
    stacks = (user, kernel)
    ignored = Counters()
    for facts in summaries:
        yield [active, *last, len(stacks[0]), *(v for s in stacks for f in s for v in f)]
        kind, time, trace, cpu = facts["first"]
        if active != kind:
            restart(stacks[kind], time, trace, cpu)
        for name, stack in zip(("user", "kernel"), stacks):
            if facts[f"{name}Cleared"]:
                stack.clear()
            if facts[f"{name}Restart"]:
                restart(stack, *facts[f"{name}Restart"])
            _replay(stack, facts[f"{name}Steps"], ignored)
        active, last = facts["active"], (facts["lastTrace"], facts["lastCpu"], facts["lastTime"])


def unpack_state(flat: list[int]):
    active, trace, cpu, time, user_size = flat[:5]
    frames = [flat[at:at + FRAME_WIDTH] for at in range(5, len(flat), FRAME_WIDTH)]
    return active, trace, cpu, time, frames[:user_size], frames[user_size:]
