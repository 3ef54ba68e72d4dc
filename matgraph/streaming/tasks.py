"""How far a step's Spark jobs are, as Spark itself tells it: by the tag that its jobs carry."""

from __future__ import annotations

from typing import Any


class TaskWatch:
    """Counts the tasks of the jobs with a tag, from the context's status tracker. Stages that have
    begun count with all their tasks; what Spark forgets of stages that are over stays known here,
    so that both figures only grow."""

    def __init__(self, context: Any, tag: str):
        self._tracker, self._tag = context._jsc.sc().statusTracker(), tag
        #: Of each stage seen: tasks, and those that are done.
        self.stages: dict[int, tuple[int, int]] = {}

    def look(self) -> tuple[float, float] | None:
        """(done, total) now; None before a task has begun."""
        for job in self._tracker.getJobIdsForTag(self._tag):
            found = self._tracker.getJobInfo(job)
            for stage in found.get().stageIds() if found.isDefined() else ():
                known = self._tracker.getStageInfo(stage)
                if not known.isDefined():
                    continue
                info = known.get()
                done = info.numCompletedTasks()
                # A stage whose output is there already is skipped, and has neither.
                if done or info.numActiveTasks():
                    tasks, before = self.stages.get(stage, (0, 0))
                    self.stages[stage] = max(tasks, info.numTasks()), max(before, done)
        if not self.stages:
            return None
        return float(sum(d for _, d in self.stages.values())), float(sum(t for t, _ in self.stages.values()))
