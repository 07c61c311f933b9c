"""Jobs that join operators into tables: facts, scoring inputs, scores, audits."""
