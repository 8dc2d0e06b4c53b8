from mailsift.streaming.outputs import commits, read_output, write_outputs
from mailsift.streaming.scans import (
    distinct_scans, hourly_counts, read_emails, run_to_table, running_totals, score_stream, write_scans)
from mailsift.streaming.senders import last_by_sender, sender_totals

__all__ = ["commits", "distinct_scans", "hourly_counts", "last_by_sender", "read_emails", "read_output", "run_to_table",
           "running_totals", "score_stream", "sender_totals", "write_outputs", "write_scans"]
