"""Sources and sinks: member bytes, evidence logs, images."""
