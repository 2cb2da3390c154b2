"""From rules to DataFrame plans."""
