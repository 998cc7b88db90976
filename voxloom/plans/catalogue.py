"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from voxloom.plans import experiments, scenes, tasks, volumes

QUERIES: dict = volumes.QUERIES | scenes.QUERIES | experiments.QUERIES | tasks.QUERIES
SQL: dict = volumes.SQL | scenes.SQL | experiments.SQL | tasks.SQL
