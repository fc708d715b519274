"""Text compaction and corpus analytics as DataFrame operators."""
